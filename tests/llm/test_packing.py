"""Packing against the tokenizer itself and a brute-force search for the best cuts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gradeloom.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def reference_ids(texts):
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_those_of_the_tokenizer():
    from gradeloom.llm.tokens import text_ids

    rnd = random.Random(1)
    texts = ["", "  a", "a\n\n b", "x<|endoftext|>y", "a <|endoftext|> b", "<|endoftext|><|endoftext|> <|endoftext |>", "it's don't 'll", "a\x1c b", "é  ü\r\n x"]
    texts += ["".join(rnd.choice(" \n\tab1.'é日😀") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    assert [text_ids(t) + [1] for t in texts] == reference_ids(texts)


def best_cost(at, cost, length):
    best = {at[0]: 0}
    for j in range(1, len(at)):
        best[at[j]] = min(best[i] + length - (at[j] - i) for i in at[:j] if at[j] - i <= length) + cost[j]
    return best[at[-1]]


def test_cuts_are_the_cheapest():
    rnd = random.Random(2)
    for _ in range(200):
        length = rnd.choice([8, 16, 32])
        at = sorted({0, *(rnd.randint(1, 120) for _ in range(rnd.randint(1, 30)))})
        at = sorted({*at, *range(0, at[-1], length)})
        cost = [0] + [rnd.choice([0, 3, 9]) for _ in at[1:]]
        cuts = packing.windows(at, cost, length)
        got = sum(length - (b - a) + cost[at.index(b)] for a, b in zip(cuts, cuts[1:]))
        assert max(b - a for a, b in zip(cuts, cuts[1:])) <= length
        assert got == best_cost(at, cost, length)


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_every_id_lies_in_one_piece(odd, odd_rows, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rows = packing.pack(odd, 64, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    want = defaultdict(int)
    for (i, *_), ids in zip(odd_rows, reference_ids([t for _, t, *_ in odd_rows])):
        want[i] += len(ids)
    assert {i: sum(r.length for r in p) for i, p in pieces.items()} == want
    whole = {i: ids for (i, *_), ids in zip(odd_rows, reference_ids([t for _, t, *_ in odd_rows])) if i in (0, 1, 4, 7, 8)}
    for i, ids in whole.items():
        ordered = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in ordered for x in r.ids] == ids and {r.doc_tokens for r in ordered} == {len(ids)}


def test_little_padding(tables):
    sizes = defaultdict(int)
    for r in packing.pack(tables.documents.coalesce(1)).collect():
        sizes[r.sequence_id] += r.length
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding < 0.03 * sum(sizes.values())


def test_empty_table_and_wrong_length(nothing):
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, 1000)
