"""Kernels of the operators against plain Python, without Spark."""

import io
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import bpe, fingerprints, languages, neardup, packing, quality, shards, substring, tokenfile

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ñ", "<|endoftext|>", "<|startoftext|>", "'s", "1", "23", "!", "...", "\x1c", "　", "the", " the", "中", "é", "́", "Σ", "ß", "\r\n", "\x85", "😀", "<|", "İ", "²"]


@pytest.fixture(scope="module")
def encoders():
    return [bpe.PieceEncoder(BYTE), bpe.PieceEncoder(WORD)]


def test_pieces_against_library(encoders):
    r = random.Random(1)
    for enc in encoders:
        for _ in range(2000):
            text = "".join(r.choice(PARTS) for _ in range(r.randrange(25)))
            ids = enc.tok.encode(text, add_special_tokens=False).ids
            assert enc.encode(text).tolist() == ids, text
            assert enc.decode(ids) == enc.tok.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_against_library(text):
    for path in (BYTE, WORD):
        enc = bpe.encoder(path)
        assert enc.encode(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_vocabulary_against_library(encoders):
    for enc in encoders:
        for token in list(enc.tok.get_vocab())[::17]:
            for text in (token.replace("</w>", ""), token.replace("</w>", "").upper() + ","):
                assert enc.encode(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh", "0123456789", "é中😀", " ", "=-*"])
def test_tree_concatenation(encoders, letters):
    enc, r = encoders[0], random.Random(2)
    for n in (4096, 9001, 30000):
        text = "x " + "".join(r.choice(letters) for _ in range(n)) + " end"
        want = enc.tok.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == want
        got = []
        for is_run, piece in bpe.units(enc, text):
            got += enc.concatenate([enc.leaf(piece[a:b]) for a, b in bpe.halves(len(piece))]) if is_run else enc.encode(piece).tolist()
        assert got == want


def test_small_table_forgets():
    enc = bpe.PieceEncoder(BYTE, remembered=3)
    text = "one two three four five six seven"
    assert enc.encode(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    values = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    for n in (0, 1, 7, 1000):
        assert (tokenfile.from_planes(tokenfile.to_planes(values[:n], kind), n, "<u4", kind) == values[:n]).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_file(kind):
    r = np.random.default_rng(2)
    docs = [(k * 3 - 5, r.integers(0, 50000, n, dtype=np.int64).astype("<u4")) for k, n in enumerate([0, 1, 500, 3, 0, 1200, 64, 64])]
    out = io.BytesIO()
    writer = tokenfile.TokenFileWriter(out, kind, block_ids=64)
    for key, ids in docs:
        writer.append(key, ids)
    writer.close()
    reader = tokenfile.TokenFileReader(out)
    assert [(k, x.tolist()) for k, x in reader.documents()] == [(k, x.tolist()) for k, x in docs]
    whole = np.concatenate([x for _, x in docs])
    for a, b in ((0, 0), (0, 1), (63, 65), (100, 1700), (0, len(whole))):
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError):
        tokenfile.TokenFileReader(io.BytesIO(b"x" * 40))


def filled(lots, counts, capacity=packing.CAPACITY):
    """Checks a plan and gives its number of sequences."""
    places, used = {}, {}
    for n, rank, k, s, offset in packing.placements(lots).tolist():
        places.setdefault(n, []).append((rank, k))
        for i in range(k):
            used.setdefault(s + i, []).append((offset, n))
    for n, c in counts.items():
        at = 0
        for rank, k in sorted(places.get(n, [])):
            assert rank == at
            at += k
        assert at == c
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    return len(used)


@pytest.mark.parametrize("draw", [lambda r: min(2048, int(r.lognormvariate(6.2, 1)) + 1), lambda r: r.randint(1, 2048), lambda r: r.randint(600, 1100), lambda r: 700, lambda r: 1])
def test_packing_plans(draw):
    r = random.Random(3)
    for n in (0, 1, 40, 3000):
        counts = dict(Counter(draw(r) for _ in range(n)))
        least = -(-sum(k * c for k, c in counts.items()) // 2048)
        got = filled(packing.plan(counts), counts)
        firm = sum(c for k, c in counts.items() if k > 1024)  # each needs a sequence of its own
        third = sum(c for k, c in counts.items() if k > 682)
        assert got <= 1.1 * max(least, firm, -(-third // 2)) + 3


def test_knapsack_fits():
    value, column = packing.knapsack([700, 600, 500], np.array([0.4, 0.33, 0.26]), 2048)
    assert (np.array([700, 600, 500]) @ column) <= 2048 and value == pytest.approx(np.array([0.4, 0.33, 0.26]) @ column)


def test_weighted_samples_estimate_jaccard():
    r = random.Random(5)
    sampler = fingerprints.Sampler(samples=1024)
    for share in (0.1, 0.5, 0.9):
        a = [b"w%d" % r.randrange(200) for _ in range(500)]
        b = [w if r.random() < share else b"v%d" % r.randrange(200) for w in a]
        x, y = Counter(a), Counter(b)
        want = sum((x & y).values()) / sum((x | y).values())
        assert abs(fingerprints.likeness(sampler.codes(a), sampler.codes(b)) - want) < 0.06
    assert (sampler.codes(a) == fingerprints.Sampler(samples=1024, remembered=7).codes(a)).all()
    assert fingerprints.likeness(None, None) == 1 and fingerprints.likeness(None, sampler.codes(a)) == 0 and fingerprints.to_hex(None) == ""


def repeated_model(words, n=8):
    seen = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    return len({j for k in range(len(words) - n + 1) if seen[tuple(words[k : k + n])] > 1 for j in range(k, k + n)})


def test_repeated_words():
    r = random.Random(6)
    for _ in range(300):
        words = [r.choice([b"a", b"b"]) for _ in range(r.randrange(40))]
        assert quality.repeated_words(words) == repeated_model(words)


def test_statistics():
    assert quality.statistics(None) == (0,) * 8
    n, chars, symbols, lines, *_ = quality.statistics("a# é\n\n a#\xa0é \na# é\n a#\xa0é \nB B")
    assert (n, chars, symbols, lines) == (8, 16, 4, 2)
    assert quality.consistency(0.75, 6) > 1


def test_keys_meet():
    r = np.random.default_rng(7)
    met = 0
    for _ in range(1500):
        n = int(np.exp(r.uniform(0, 6.5)))
        a = np.unique(neardup.mixed(r.integers(0, 2**63, n).astype(np.uint64)))
        gone = int(len(a) * r.uniform(0, 0.25))
        new = int(r.uniform(0, 1) * gone)
        b = np.unique(np.r_[r.permutation(a)[gone - new :], neardup.mixed(r.integers(0, 2**63, new).astype(np.uint64))])
        if len(b) and neardup.linked(a, b):
            met += 1
            (x, v), (y, w) = neardup.keys(a), neardup.keys(b)
            assert len(np.intersect1d(x, y))
            # What they share in some band is more than either could spare there.
            same = set(x.tolist()) & set(y.tolist())
            shared = Counter()
            for key, note in zip(x.tolist(), v.tolist()):
                if key in same:
                    shared[note >> 20] += note & 3
            spare = {}
            for note in [*v.tolist(), *w.tolist()]:
                spare.setdefault(note >> 20, set()).add(note >> 2 & 0xFFFF)
            if all(len(s) <= 2 for s in spare.values()):
                assert any(shared[k] > max(spare[k]) for k in shared)
            assert 9 * sum(bin(int(p) & (2**64 - 1)).count("1") for p in neardup.bitmap(a) ^ neardup.bitmap(b)) <= len(a) + len(b)
    assert met > 500


def test_common_passages_meet_rarely():
    """A passage that all documents share is no meeting place as long as they don't link: pairs to look at grow at most as the documents do."""
    met = []
    for docs in (500, 1000, 2000):
        sets = [neardup.shingles(" ".join([f"own{d}x{k}" for k in range(14 + d % 7)] + [f"all{k}" for k in range(60)])) for d in range(docs)]
        top = np.uint64(64 - neardup.CELLS.bit_length() + 1)
        frequency = np.bincount((np.concatenate(sets) >> top).astype(np.int64), minlength=neardup.CELLS)
        under = Counter(e for x in sets for e in neardup.first_elements(x, frequency)[0].tolist())
        fit = Counter((e, m >= len(x)) for x in sets for e, m in zip(*map(np.ndarray.tolist, neardup.first_elements(x, frequency))))
        met.append(sum(fit[e, True] * n for e, n in under.items() if n > 1))
    assert met[1] <= 2 * met[0] + 100 and met[2] <= 2 * met[1] + 100


def test_first_elements():
    """Linked sets meet under an element whose places and sizes allow it, whatever the frequencies."""
    r = np.random.default_rng(3)
    for _ in range(400):
        pool = neardup.mixed(r.integers(0, 2**63, int(r.integers(2, 90))).astype(np.uint64))
        a, b = (np.unique(r.choice(pool, max(1, int(len(pool) * r.uniform(0.8, 1))), replace=False)) for _ in range(2))
        if neardup.linked(a, b):
            frequency = r.integers(0, 5, neardup.CELLS)
            x, y = (dict(zip(*map(np.ndarray.tolist, neardup.first_elements(s, frequency)))) for s in (a, b))
            assert any(len(b) <= x[e] and len(a) <= y[e] for e in set(x) & set(y))


def test_first_differences():
    """Linked sets, one of which does not link with the head, meet by how they differ from it, the one that needs less early."""
    r, met = np.random.default_rng(4), 0
    fresh = lambda n: neardup.mixed(r.integers(0, 2**63, int(n)).astype(np.uint64))
    for _ in range(1500):
        n = int(r.integers(5, 150))
        pool = fresh(n)
        changed = lambda s, share: np.unique(np.r_[r.permutation(s)[int(len(s) * r.uniform(0, share)) :], r.choice(pool, 2), fresh(r.integers(0, 1 + len(s) * share))])
        head = changed(pool, 0.15)
        a = changed(pool, 0.15)
        b = changed(a, 0.12)
        far = [not neardup.linked(s, head) for s in (a, b)]
        if not neardup.linked(a, b) or not any(far):
            continue
        met += 1
        frequency = r.integers(0, 5, neardup.CELLS)
        (da, na), (db, nb) = (neardup.difference(s, head) for s in (a, b))
        x, y = (dict(zip(*map(np.ndarray.tolist, neardup.first_differences(d, need, neardup.least_need(len(s), need, len(head), f), frequency)))) for s, d, need, f in ((a, da, na, far[0]), (b, db, nb, far[1])))
        if na + nb <= 0:
            assert not all(far)
        else:
            assert any(x[e] >= nb and y[e] >= na and (x[e] >= na if na <= nb else y[e] >= nb) for e in set(x) & set(y))
    assert met > 200


def test_bands():
    for n in range(1, 3000):
        own, *more = neardup.bands(n)
        low, high, differ, m, q = neardup.band(own)
        assert low <= n <= high and m + min(q, m) > differ and q <= m
        assert neardup.band([own, *more][-1] + 1)[0] * 80 > 100 * n


def test_shingles():
    assert len(neardup.shingles(None)) == len(neardup.shingles(" \t\n")) == 0
    assert len(neardup.shingles("a b")) == 1 and len(neardup.shingles("a b c d e f")) == 2
    assert (neardup.shingles("A B") == neardup.shingles("a  b")).all() and len(neardup.shingles("É b")) == 1 and (neardup.shingles("É") != neardup.shingles("é")).all()
    assert not neardup.linked(neardup.shingles(""), neardup.shingles(""))


def test_factors():
    start, source, at = np.array([5, 6, 7, 9, 10, 6]), np.array([1, 1, 1, 2, 2, 1]), np.array([0, 1, 2, 4, 9, 1])
    assert substring.factors(start, source, at) == [(5, 22, 1, 0), (9, 20, 2, 4), (10, 20, 2, 9)]
    assert substring.covered(31, substring.factors(start, source, at)).tolist() == [False] * 5 + [True] * 25 + [False]
    assert substring.without("a  b\nc d", [(1, 2, 0, 0)]) == "a d" and substring.without(" a b", [(0, 1, 0, 0)]) == "b" and substring.without("a b \n", [(1, 1, 0, 0)]) == "a \n"


def test_slot_maps():
    r = random.Random(8)
    size = Counter()
    for _ in range(20000):
        size[r.randrange(shards.SLOTS)] += int(r.lognormvariate(7, 1))
    even = shards.SlotMap.even(24)
    balanced = even.rebalanced(size)
    load = Counter()
    for slot, shard in enumerate(balanced.shard_of):
        load[shard] += size[slot]
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values()) / 24 and balanced.version == 1
    grown = balanced.grown(size)
    assert all(a == b or b == 24 for a, b in zip(balanced.shard_of, grown.shard_of)) and grown.shards == 25 and 24 in grown.shard_of
    assert shards.SlotMap.even(3, 9).rebalanced({}).shard_of == shards.SlotMap.even(3, 9).shard_of


def test_language_counts():
    assert languages.counts("aB").sum() == 4 and (languages.counts("ab") == languages.counts("AB")).all() and languages.counts("").sum() >= 0
    assert not languages.has_letter("12 !") and languages.has_letter("é")


def test_checksum_of_ids():
    assert zlib.crc32(bpe.ids_to_bytes([1, 2])) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
