"""Quality rules as a cascade that stops at the first rule a text fails.

Some figures are counted for every text; a text that fails by them alone goes no further. The rules after them are each
tried, on a sample, on all texts: what a rule takes a text, and which texts it rejects. The next rule of the cascade is the one
that rejects most of what the rules before it left, for its time. Over the whole table a rule sees only the texts that all
rules before it let pass. Order changes the work, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import SPACE, chunks, flat, free_tables, release_memory, runs_of

#: Texts on which costs and rejections are estimated, about. The only bound here: all rules read whole texts.
SAMPLE_ROWS = 2000
#: Fixed by the contract: words that a text needs, and the most of 100 words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_UPPER, _LOWER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Texts:
    """Some texts as bytes, with their words and lines, cut when first asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends, self.first = runs_of(~SPACE[raw], offsets)
        self.first[-1] = len(self.starts)
        self.n_words = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def a_row(self, member: np.ndarray) -> np.ndarray:
        """For each text, the true ones among its bytes."""
        total = np.concatenate(([0], np.cumsum(member)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def a_word(self, member: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(member)))
        return total[self.ends] - total[self.starts]

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of_words)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def word_ids(self) -> np.ndarray:
        if not hasattr(self, "_ids"):
            self._ids = _ids(self.raw, self.starts, self.ends)
        return self._ids

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, starts and ends of the lines that have a word."""
        if not hasattr(self, "_lines"):
            cut = self.raw == 10
            starts, ends, first = runs_of(~cut, self.offsets)
            words = np.concatenate(([0], np.cumsum(~SPACE[self.raw])))
            first[-1] = len(starts)
            rows = np.repeat(np.arange(len(self.n_words)), np.diff(first))
            full = words[ends] > words[starts]
            self._lines = rows[full], starts[full], ends[full]
        return self._lines

    def only(self, keep: np.ndarray) -> "Texts":
        """The texts at some places, in order."""
        size = np.diff(self.offsets)[keep]
        offsets = np.concatenate(([0], np.cumsum(size)))
        return Texts(self.raw[np.repeat(self.offsets[keep] - offsets[:-1], size) + np.arange(offsets[-1])], offsets)


def _ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal bytes and for no others."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())])
    return np.asarray(held.dictionary_encode().indices).astype(np.int64)


def _repeats(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each id stands in its row, and a number for each pair of row and id."""
    pair, again, n = np.unique(rows * (ids.max(initial=0) + 1) + ids, return_inverse=True, return_counts=True)
    return n[again], again, pair


def base_figures(t: Texts) -> dict[str, np.ndarray]:
    n = len(t.n_words)
    follows_on = (t.raw & 0xC0) == 0x80  # later bytes of a character
    row, starts, ends = t.lines()
    _, _, different = _repeats(row, ids := _ids(t.raw, starts, ends))
    different_rows = different // (ids.max(initial=0) + 1)
    lines = np.bincount(row, minlength=n)
    repeated = np.zeros(len(t.starts), bool)
    ids, rows = t.word_ids(), t.rows()
    if len(ids) >= WINDOW:
        window = ids
        for k in range(1, WINDOW):  # numbers of words, of pairs, of threes: none leaves 64 bits
            window = np.unique(window[:-1] * (len(ids) + 1) + ids[k:], return_inverse=True)[1]
        at = np.flatnonzero(rows[: len(window)] == rows[WINDOW - 1 :])
        often, _, _ = _repeats(rows[at], window[at])
        for k in range(WINDOW):
            repeated[at[often > 1] + k] = True
    return {
        "n_words": t.n_words,
        "word_chars": t.sums(t.a_word(~follows_on)),
        "n_symbols": t.a_row(_SYMBOL[t.raw]),
        "n_dup_lines": lines - np.bincount(different_rows, minlength=n),
        "n_repeat_words": t.sums(repeated),
        "_lines": lines,
    }


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: What a rule gets: texts and their figures. It says which texts fail.
Rule = Callable[[Texts, dict[str, np.ndarray]], np.ndarray]


def many_symbols(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """More than 15 symbols for 100 words."""
    return 100 * f["n_symbols"] > 15 * f["n_words"]


def odd_length(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """Words of under 2 or over 15 characters on average."""
    return (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])


def repeated_lines(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """More than half of the lines repeat an earlier one."""
    return 100 * f["n_dup_lines"] > 50 * f["_lines"]


def few_letters(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """Under 70 of 100 words have an ASCII letter or a character beyond ASCII."""
    return 100 * t.sums(t.a_word(_LETTER[t.raw]) > 0) < 70 * f["n_words"]


def capitals(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    upper = t.a_row(_UPPER[t.raw])
    return upper > t.a_row(_LOWER[t.raw])


def exclamations(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """More than 30 exclamation marks for 100 words."""
    return 100 * t.a_row(t.raw == 33) > 30 * f["n_words"]


def broken_lines(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """More than 40 of 100 lines end with three full stops."""
    row, starts, ends = t.lines()
    dots = np.concatenate(([0], np.cumsum(t.raw == 46)))
    cut = (ends - starts >= 3) & (dots[ends] - dots[np.maximum(ends - 3, 0)] == 3)
    return 100 * np.bincount(row[cut], minlength=len(t.n_words)) > 40 * f["_lines"]


def one_word(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """One word, as it is written, is more than 30 of 100 words."""
    often, _, _ = _repeats(rows := t.rows(), t.word_ids())
    most = np.zeros(len(t.n_words), np.int64)
    np.maximum.at(most, rows, often)
    return 100 * most > 30 * f["n_words"]


RULES: dict[str, Rule] = {f.__name__: f for f in (many_symbols, odd_length, repeated_lines, few_letters, capitals, exclamations, broken_lines, one_word)}


def _with_base(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts, dict[str, np.ndarray], np.ndarray]]:
    for batch in batches:
        raw, offsets = flat(batch.column("text"))
        for a, b in chunks(offsets):
            t = Texts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            figures = base_figures(t)
            failed = (t.n_words < LEAST_WORDS) | (100 * figures["n_repeat_words"] > MOST_REPEATED * t.n_words)
            yield batch.slice(a, b - a), t, figures, failed
        release_memory()


def _trial(batches: Iterable[pa.RecordBatch], rules: dict[str, Rule]) -> Iterator[pa.RecordBatch]:
    """(rule, mask, n, ns): the time of each rule over n texts; and with rule '', the texts that fail just the rules of a mask."""
    for _, t, figures, failed in _with_base(batches):
        at = np.flatnonzero(~failed)
        t, figures = t.only(at), {k: v[at] for k, v in figures.items()}
        masks, out = np.zeros(len(at), np.int64), []
        for i, (name, rule) in enumerate(rules.items()):
            for kept in ("_ids", "_lines"):  # each rule pays for what it needs
                t.__dict__.pop(kept, None)
            began = time.thread_time_ns()
            masks |= rule(t, figures).astype(np.int64) << i
            out.append((name, 0, len(at), time.thread_time_ns() - began))
        out += [("", int(m), int(n), 0) for m, n in zip(*np.unique(masks, return_counts=True))]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["rule", "mask", "n", "ns"])


def best_order(costs: dict[str, float], masks: dict[int, int]) -> list[str]:
    """Rules by rejections for their cost, each counted on what the rules before it let pass.

    masks: how many texts fail just the rules of a mask, whose bits are the rules in their order in costs. Rules that
    reject nothing more come last, cheapest first.
    """
    names, left, order = list(costs), dict(masks), []
    while len(order) < len(names):
        hits = {k: sum(n for m, n in left.items() if m >> i & 1) for i, k in enumerate(names) if k not in order}
        best = min(hits, key=lambda k: (-hits[k] / max(costs[k], 1e-9), costs[k], k))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> names.index(best) & 1}
    return order


def plan(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The cascade's order for these texts. Rows are drawn one by one, so copies of a text don't all come along; what comes back is a row a rule and a mask."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    tried = docs.select("text").where(F.rand(11) < share).mapInArrow(lambda bs: _trial(bs, rules), "rule string, mask bigint, n bigint, ns bigint")
    rows = tried.groupBy("rule", "mask").agg(F.sum("n").alias("n"), F.sum("ns").alias("ns")).collect()
    costs = {r["rule"]: r["ns"] / max(1, r["n"]) for r in rows if r["rule"]}
    return best_order({k: costs.get(k, 0.0) for k in rules}, {r["mask"]: r["n"] for r in rows if not r["rule"]})


def _verdicts(batches: Iterable[pa.RecordBatch], rules: list[tuple[str, Rule]]) -> Iterator[pa.RecordBatch]:
    free_tables()
    for batch, t, figures, failed in _with_base(batches):
        by = np.full(len(failed), "", object)
        by[failed] = "base"
        at = np.flatnonzero(~failed)
        left, own = t, figures
        if len(at) < len(failed):
            left, own = t.only(at), {k: v[at] for k, v in figures.items()}
        for name, rule in rules:
            if not len(at):
                break
            bad = rule(left, own)
            if bad.any():
                by[at[bad]] = name
                left, own, at = left.only(np.flatnonzero(~bad)), {k: v[~bad] for k, v in own.items()}, at[~bad]
        columns = [batch.column("_row"), *[pa.array(figures[k], pa.int64()) for k in FIGURES], pa.array(failed), pa.array(by == ""), pa.array([x or None for x in by], pa.string())]
        yield pa.record_batch(columns, ["_row", *FIGURES, "base_failed", "kept", "failed_rule"])


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs without their text, with FIGURES, base_failed, kept, and failed_rule: the rule at which the cascade stopped.

    failed_rule depends on the order, all else doesn't. A null or empty text has no words and fails; very long texts are judged
    whole; each row is judged by itself, so repeated rows get one verdict. Columns of docs with names of the new ones go.
    """
    order = [(k, rules[k]) for k in plan(docs, rules, sample_rows)]
    new = [*FIGURES, "base_failed", "kept", "failed_rule"]
    others = [c for c in docs.columns if c != "text" and c not in new]
    slim = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row"), "text")
    schema = f"_row {slim.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{k} bigint" for k in FIGURES) + ", base_failed boolean, kept boolean, failed_rule string"
    out = slim.mapInArrow(lambda bs: _verdicts(bs, order), schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in others], *new)
