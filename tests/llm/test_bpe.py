import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import cases

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quaylight.llm import bpe, packing, tokenstore  # noqa: E402
from quaylight.llm.common import shared_dir  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def ids_of(texts):
    return [e.ids for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(1)
    letters = list("aAbBÉéΣςßİǅﬁ'stré.,!?0123 \t\n　  \x85\x1c\x1f​́̈漢字🙂<|>٣²½-:;$#") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "aaaaaaaa" * 50, "́abc", "x" * 20000, "A.B a.'s A'S,", "b" * 4095, *cases.twins(), " ".join(cases.twins())]


@pytest.mark.parametrize("library", [False, True])
def test_ids_equal_the_librarys(library):
    texts = odd_texts()
    got = [x[i:j].tolist() for _, x, at in bpe.row_ids(pa.array(texts), PATH, library) for i, j in zip(at, at[1:])]
    assert got == ids_of(texts)


def test_full_table_starts_anew():
    table = bpe.PieceTable(bpe.word_bpe(PATH).encode_pieces, most=50)
    for texts in (["alpha beta gamma"] * 3, [f"word{i} other{i}" for i in range(100)], ["alpha beta"]):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        ids, at = table.ids(raw, np.cumsum([0, *map(len, texts)]))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == ids_of(texts)


def test_merge_rounds_equal_one_by_one():
    b = bpe.word_bpe(PATH)
    rank = dict(zip(b.keys.tolist(), b.ranks.tolist()))
    rng = random.Random(2)
    words = ["".join(rng.choice("aetnhs") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for w, got in zip(words, b.merge([w.encode() for w in words])):
        s = [int(b.inner[c]) for c in w.encode()]
        s[-1] = int(b.last[w.encode()[-1]])
        while True:
            pairs = [(rank[k], i) for i in range(len(s) - 1) if (k := s[i] << 32 | s[i + 1]) in rank]
            if not pairs:
                break
            r, i = min(pairs)
            s[i : i + 2] = [int(b.made_by_rank[r])]
        assert np.frombuffer(got, "<u4").tolist() == s


def test_digests(spark):
    rows = cases.odd_rows()
    got = bpe.round_trip_digests(cases.documents(spark, rows), PATH).collect()
    want = []
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows])):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = bpe.encode_decode(cases.documents(spark, rows), PATH).where("doc_id = 7").first()
    assert full["ids"] == ids_of([rows[8][1]])[0] and full["decoded"] == LIB.decode(full["ids"], skip_special_tokens=False)
    assert bpe.round_trip_digests(cases.documents(spark, []), PATH).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    rng = random.Random(5)
    rows = cases.odd_rows() + [(100 + i, cases.text(rng, rng.randint(1, 60))) for i in range(200)] + [(400 + i, "tie tie") for i in range(150)]
    capacity = 64
    got = packing.pack_documents(cases.documents(spark, rows), PATH, capacity).collect()
    want = []
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows])):
        ids = [*ids, 1]
        want += [(i, k, b, len(ids[b : b + capacity]), crc(ids[b : b + capacity])) for k, b in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in got)
    assert len(used) <= -(-total // capacity) * 1.03 + 1
    assert packing.pack_documents(cases.documents(spark, []), PATH).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(6)
    for _ in range(30):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan_slots(histogram, 40)
        rooms = []  # one by one
        for n in sorted(lengths, reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                i = min(fit, key=lambda i: rooms[i])
                rooms[i] -= n
            else:
                rooms.append(40 - n)
        assert len({s for _, a, b, first, _ in plan for s in range(first, first + b - a)}) == len(rooms)
        for n, c in histogram.items():
            assert sorted(k for m, a, b, *_ in plan if m == n for k in range(a, b)) == list(range(c))


def test_token_store(spark):
    rng = random.Random(8)
    rows = cases.odd_rows() + [(1000 - i, cases.text(rng, rng.randint(1, 80), 30)) for i in range(300)]
    docs = cases.documents(spark, rows)
    files = tokenstore.write_shards(docs, shared_dir(spark), PATH, shard_tokens=2000)
    assert files.count() > 3
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_shards(files).collect() if r["doc_id"] is not None)
    every = [(i, [*ids, 1]) for (i, _), ids in zip(rows, ids_of([t for _, t in rows]))]
    every.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for i, ids in every:
        if i is not None:
            want.append((start, i, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    empty = cases.documents(spark, [])
    assert tokenstore.read_shards(tokenstore.write_shards(empty, shared_dir(spark), PATH)).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(9)
    ids = [rng.choice([7, 8, 9, 10, 49407], size=n, p=[0.5, 0.3, 0.1, 0.05, 0.05]) for n in (0, 1, 5, 4000, 3000, 2)]
    raw = tokenstore.shard_bytes([3, None, 5, 6, 7, 8], ids)
    shard = tokenstore.Shard(raw)
    assert len(shard.rules) > 5 and len(shard.symbols) < 0.6 * sum(map(len, ids))
    for k, x in enumerate(ids):
        assert shard.document(k).tolist() == x.tolist()
    assert shard.symbol_sizes().sum() == sum(map(len, ids))
    assert [len(tokenstore.expand(np.array([tokenstore.FIRST_NONTERMINAL + i]), shard.rules)) for i in range(len(shard.rules))] == shard.lengths.tolist()
    with pytest.raises(ValueError):
        tokenstore.Shard(raw[:-3])
    with pytest.raises(ValueError):
        tokenstore.Shard(b"x" + raw)


def test_grammar_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    texts = [np.full(1000, 7), np.tile([1, 2, 3], 200), np.zeros(0, np.int64), np.array([5]), np.tile([1, 2], 25), rng.integers(0, 40, 3000), rng.zipf(1.3, 4000) % 500]
    flat, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    symbols, owners, rules = tokenstore.compress(flat, owner)
    assert (tokenstore.expand(symbols, rules) == flat).all() and len(symbols) < 0.8 * len(flat)
    pair = (symbols[:-1] << 32 | symbols[1:])[owners[:-1] == owners[1:]]
    assert np.unique(pair, return_counts=True)[1].max() < tokenstore.LEAST_COUNT
    lengths = tokenstore.expansion_lengths(rules)
    for k in range(len(texts)):
        own = symbols[owners == k]
        assert np.where(own >= tokenstore.FIRST_NONTERMINAL, lengths[np.maximum(own - tokenstore.FIRST_NONTERMINAL, 0)], 1).sum() == len(texts[k])
    everything = np.concatenate((symbols, rules.ravel()))
    assert set(range(len(rules))) == set((everything[everything >= tokenstore.FIRST_NONTERMINAL] - tokenstore.FIRST_NONTERMINAL).tolist())  # no rule without a use


def test_rounds_of_the_grammar_count_only_pairs_that_can_be_frequent(monkeypatch):
    """Later rounds sort new pairs, not all again; the grammar is that of counting all."""
    rng = np.random.default_rng(5)
    flat = np.concatenate([np.tile(rng.integers(0, 50, 40), 30), rng.integers(0, 3000, 30_000)])
    owner = np.arange(len(flat)) // 900
    sorted_ = []
    plain = np.sort
    monkeypatch.setattr(tokenstore.np, "sort", lambda x, *a, **k: (sorted_.append(len(x)), plain(x, *a, **k))[1])
    symbols, _, rules = tokenstore.compress(flat, owner)
    assert len(rules) > 30 and len(sorted_) > 3 and sum(sorted_) < 1.5 * len(flat)
    assert (tokenstore.expand(symbols, rules) == flat).all()
