"""The registered queries against brute force: on the smallest tables and on awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm import common, languages, neardup, packing, pii, quality, shards, substring, tokenfile
from emberlog.llm import queries as llm

from ..conftest import SF
from . import brute

ALL = llm.queries()


def library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return tok


def awkward():
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "Gamma,", "delta", "épsilon", "zeta.", "eta", "theta"]) + str(r.randrange(60)) for _ in range(n))
    base = prose(120)
    words = base.split()
    near = [" ".join(words[:k] + ["CHANGED"] + words[k + 1 :]) for k in (3, 50, 110)]
    passage = prose(55)
    rows = [
        None, "", " \n\t ", "x", "12 !", base, base, base.upper(), *near, " ".join(words[:90]), passage + " " + prose(40), prose(30) + "\n" + passage, passage,
        "<|endoftext|> a  b<|startoftext|>", "a" * 9000, "中" * 5000 + " end", " " * 5000, prose(20000), prose(3000) + " " + prose(3000), "one two three four", "One  TWO three\nfour",
        "mail a.b+c@x-y.example.com, +1 (234) 555-0199 and 4111 1111 1111 1111; 10.0.0.256 9.8.7.6 d@e.f_g@h.i +1 x", "dup line here\ndup line here\n" * 20, "\x1c odd\x85 spaces　here", "😀 " * 300 + "t@u.vw",
    ]
    return [(k * 7 - 20, t) for k, t in enumerate(rows)]


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def case(request, spark, tmp_path_factory):
    """(folder, rows): documents with extra columns whose names the operators use themselves."""
    if request.param == "small":
        return SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = awkward() if request.param == "awkward" else []
    folder = str(tmp_path_factory.mktemp(request.param))
    data = [(k, t, [None, "en", "fr"][n % 3], None if n % 4 == 0 else f"s{n % 2}", len(t or ""), "y", 1, 2) for n, (k, t) in enumerate(rows)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row bigint, component_id bigint"
    spark.createDataFrame(data, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def got(spark, name, folder, *columns):
    rows = ALL[name](spark, folder).collect()
    found = {r.doc_id: tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1(spark, case):
    folder, rows = case
    assert got(spark, "op1_bpe", folder, "n_tokens", "ids_sha256", "decoded_sha256") == brute.tokens(rows, library("byte_bpe_50k.json"))


def test_op2(spark, case):
    folder, rows = case
    assert got(spark, "op2_substring", folder, "n_words", "n_removed", "kept_sha256") == brute.substrings(rows)


def test_op3(spark, case):
    folder, rows = case
    assert got(spark, "op3_cws", folder, "n_chars", "edited_sha256") == brute.edits(rows)
    found = got(spark, "op3_cws", folder, "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    text = dict(rows)
    for a, (mark, changed, near, far) in found.items():
        assert 0 <= near <= 1 and 0 <= far <= 1 and (near == 1 if mark == changed else near < 1)
        assert all(found[b][0] == mark for b in found if text[b] == text[a])
    order = sorted(found)
    for a, b in zip(order, order[1:]):
        x, y = found[a][0], found[b][0]
        same = sum(x[k : k + 4] == y[k : k + 4] for k in range(0, len(x), 4)) / 64 if x and y else float(x == y)
        assert found[a][3] == same


def test_op4(spark, case):
    folder, rows = case
    assert got(spark, "op4_planes", folder, "start", "n_tokens", "ids_crc32") == brute.planes(rows, library("word_bpe_49k.json"))


def test_op5(spark, case):
    folder, rows = case
    assert got(spark, "op5_quality", folder, "n_words", *quality.STATISTICS, "base_failed") == brute.quality(rows)
    assert not any(kept for failed, kept in got(spark, "op5_quality", folder, "base_failed", "kept").values() if failed)


def test_op6(spark, case):
    folder, rows = case
    found = got(spark, "op6_pii", folder, *(f"n_{k}" for k in brute.BASE), "base_sha256", "spans")
    assert set(found) == {k for k, _ in rows}
    for key, text in rows:
        own = brute.private(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        counts = Counter(k for k, _, _ in own)
        assert found[key][:5] == (*(counts[k] for k in brute.BASE), brute.sha(listed)), text
        assert set(listed.split(",")) <= set(found[key][5].split(","))


def test_op7(spark, case):
    folder, rows = case
    found = got(spark, "op7_languages", folder, "held_out", "lang_pred", "score")
    for key, text in rows:
        held, language, score = found[key]
        assert held == (zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= score <= 1
        assert (language == "und") == (not any(c.isalpha() for c in text or ""))


def test_op8(spark, case):
    folder, rows = case
    found = got(spark, "op8_shards", folder, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    shards_of = defaultdict(list)
    for key, text in rows:
        size, crc, law, shard, slot, grown = found[key]
        assert size == len((text or "").encode()) + 8 and crc == zlib.crc32((text or "").encode()) and law == "bytes" and grown is None and 0 <= shard < 24
        shards_of[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards_of.values())


def test_op9(spark, case):
    folder, rows = case
    assert got(spark, "op9_neardup", folder, "n_shingles", "component_id") == brute.near(rows)


def test_op10(spark, case):
    folder, rows = case
    tok, text = library("byte_bpe_50k.json"), dict(rows)
    found = ALL["op10_packing"](spark, folder).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in found:
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(own) == set(text)
    for key, pieces in own.items():
        ids = tok.encode(text[key] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        assert sorted(pieces) == [(k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in found) // 2048) + 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 211])
def test_range_buckets(spark, n):
    r = random.Random(n)
    keys = [r.randrange(-400, 400) for _ in range(900)] + [5] * 300 + [None] * 3
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    bucket, most = common.range_buckets(docs, "doc_id", n)
    found = docs.select("doc_id", bucket.alias("b")).collect()
    shares = [k / n for k in range(1, n)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0])) if shares else []
    assert most == len(cuts) + 1
    for row in found:
        assert row.b == (0 if row.doc_id is None else sum(row.doc_id > c for c in cuts))


def test_hot_groups(spark):
    """Many copies, near copies of one original, and a passage that many share: components stay exact."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(40)]
    rows = [(k, " ".join(base)) for k in range(40)]
    for k in range(60):
        changed = list(base)
        for _ in range(r.randrange(1, 4)):
            changed[r.randrange(80)] = word()
        rows.append((100 + k, " ".join(changed)))
    for k in range(80):
        rows.append((300 + k, " ".join([word() for _ in range(r.randrange(60))] + passage + [word() for _ in range(r.randrange(20))])))
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(table).collect()} == brute.near(rows)
    left = {x.doc_id: x.text for x in substring.deduplicated(table).collect()}
    assert {k: brute.sha(" ".join(t.split())) for k, t in left.items()} == {k: v[2] for k, v in brute.substrings(rows).items()}


def most_generated(spark, since):
    """Rows of the Generate node with most of them, in executions from `since` on; and the next execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, found = store.executionsList(), [0]
    ids = [runs.apply(k).executionId() for k in range(runs.size())]
    for run in (k for k in ids if k >= since):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for m in map(metrics.apply, range(metrics.size() if node.name().startswith("Generate") else 0)):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found), max(ids, default=-1) + 1


def test_rows_in_a_large_group(spark, monkeypatch):
    """Twice as many near copies of a text, some too far from the others to link: exact, and not four times the rows."""
    monkeypatch.setattr(neardup, "STAR", 25)
    r = random.Random(21)
    base, most = [f"w{r.randrange(9000)}" for _ in range(150)], []
    _, since = most_generated(spark, 0)
    for n in (250, 500):
        rows = []
        for k in range(n):
            words = list(base)
            for at in r.sample(range(150), r.choice([1, 2, 3, 5, 6, 7])):
                words[at] = f"v{r.randrange(9000)}"
            rows.append((k, " ".join(words)))
        table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(table).collect()} == brute.near(rows)
        rows, since = most_generated(spark, since)
        most.append(rows)
    assert 0 < most[1] <= 2.5 * most[0]


@pytest.mark.parametrize("rounds", [1, 8])
def test_differences_in_common(spark, monkeypatch, rounds):
    """Texts of passages that many share, so that what differs is common too: exact by heads of heads, and by pairs where rounds end."""
    monkeypatch.setattr(neardup, "HOT", 2)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    r, asked, own = random.Random(22), [], neardup._round
    monkeypatch.setattr(neardup, "_round", lambda *x: asked.append(own(*x)) or asked[-1])
    pool = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(30)]
    rows = [(k, " ".join(p for p in pool if r.random() < 0.86)) for k in range(150)] + [(200 + k, " ".join(pool[: 30 - k] + pool[:k])) for k in range(12)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute.near(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(table).collect()} == expected
    assert 10 < len({c for _, c in expected.values()}) and asked and (rounds > 1 or asked[0][1] is None)


def test_repeated_and_nameless_rows(spark):
    rows = [(1, "same words here " * 3), (1, "same words here " * 3), (None, "no name"), (None, None)]
    table = spark.createDataFrame([(*x, None, None, 0) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((x.n_shingles, x.component_id or 0) for x in neardup.classes(table).collect()) == [(0, 0), (1, 0), (3, 1), (3, 1)]
    assert substring.digests(table).count() == pii.digests(table).count() == quality.judge(table).count() == 4
    assert shards.place(table, 3)[0].count() == 4 and languages.identify(table, languages.fit(table)).count() == 4
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokenfile.read(spark, tokenfile.write(table, path, 2, kind="bit", block_ids=8, file_ids=10), tokenfile.summary, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 4
    packed = packing.packed_documents(table, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity=16, with_ids=True)
    tokens = packing.sequences(packed)
    assert sum(len(x.ids) // 4 for x in tokens.collect()) == packed.agg(F.sum("length")).first()[0]


def test_bootstrapped_contexts(spark):
    """Contexts of known phones find numbers that the base rule does not know; elsewhere they are left alone."""
    rows = [(k, f"please call me at +1 234 555 0{k:03d} soon") for k in range(30)]
    rows += [(100 + k, f"and do call me at 555-123-{k:04d} then") for k in range(8)] + [(200 + k, f"order number of 555-777-{k:04d} parts") for k in range(8)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x.doc_id: x.spans for x in pii.digests(table).collect()}
    assert all(found[100 + k] == "phone:18:30" for k in range(8)) and all(found[200 + k] == "" for k in range(8))
    hidden = {x.doc_id: x.text for x in pii.masked(table).collect()}
    assert hidden[100] == "and do call me at <PHONE> then" and hidden[0] == "please call me at <PHONE> soon" and hidden[200] == rows[38][1]


def test_contexts_beside_other_candidates(spark):
    """An identifier within two words after another candidate, or at the start of a text, is found under its pattern."""
    rows = [(k, f"Email: a{k}@x.com Phone: +1 234 555 0{k:03d} and") for k in range(20)] + [(50 + k, f"Phone: +1 234 555 1{k:03d} and") for k in range(20)]
    rows += [(100, "Email: b@x.com Phone: 555-123-4567 and"), (101, "Phone: 555-123-4568 and"), (102, "the Parts: 555-123-4569 and")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x.doc_id: x.spans for x in pii.digests(table).collect()}
    assert found[100] == "email:7:14,phone:22:34" and found[101] == "phone:7:19" and found[102] == ""
    hidden = {x.doc_id: x.text for x in pii.masked(table).collect()}
    assert hidden[100] == "Email: <EMAIL> Phone: <PHONE> and" and hidden[101] == "Phone: <PHONE> and"


def test_identifiers_of_several_tokens(spark):
    """Phones and cards written with blanks and brackets are found as a whole; a run ends before a base span."""
    rows = [(k, f"please call me at +1 234 555 0{k:03d} soon") for k in range(30)] + [(50 + k, f"we charge my card 411111111111{k:04d} now") for k in range(10000) if brute.luhn(f"411111111111{k:04d}")][:30]
    cases = ["please call me at 555 123 4567 now", "call me at (030) 123 4567, or", "call me at 030 - 123 - 4567. Or", "charge my card 4111 1111 1111 1112 now", "call me at 555 1234567 now", "call me at 555 123 4567 10.0.0.1 x", "call me at 555 now", "count of parts 555 123 4567 now"]
    table = spark.createDataFrame(rows + [(20000 + k, t) for k, t in enumerate(cases)], "doc_id bigint, text string")
    hidden = {x.doc_id: x.text for x in pii.masked(table).collect()}
    want = ["please call me at <PHONE> now", "call me at <PHONE>, or", "call me at <PHONE>. Or", "charge my card <CARD> now", "call me at <PHONE> now", "call me at <PHONE> <IP> x", "call me at 555 now", "count of parts 555 123 4567 now"]
    assert [hidden[20000 + k] for k in range(len(cases))] == want


def test_planted_identifiers_in_prose(spark):
    """Numbers that no base rule knows, planted under contexts that known ones have: nearly all are found, and decoys elsewhere are not."""
    r = random.Random(21)
    words = "the and of to in that thing ration ent ing her ere tion hat you are was for with".split()  # none that stands beside a planted number
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    before, after = ["reach us on", "my mobile is", "phone number:"], ["after nine", "if urgent", "at work"]
    rows, planted, decoys = [], {}, set()
    for k in range(300):
        number, known = f"555-{r.randrange(1000):03d}-{k:04d}", f"+1 (555) {r.randrange(1000):03d}-{k:04d}"
        kind = k % 3
        value = known if kind == 0 else number
        a, b = (r.choice(before), r.choice(after)) if kind < 2 else (prose(2), prose(2))
        text = f"{prose(20)} {a} {value} {b} {prose(20)}"
        rows.append((k, text))
        if kind == 1:
            planted[k] = f"phone:{text.index(value)}:{text.index(value) + len(value)}"
        elif kind == 2:
            decoys.add(k)
    found = {x.doc_id: x.spans for x in pii.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(found[k] == v for k, v in planted.items()) >= 0.95 * len(planted)
    assert sum(found[k] != "" for k in decoys) <= 0.02 * len(decoys)


def test_masks_of_rows_that_share_an_id(spark):
    """Spans belong to rows: a shared doc_id, none at all, dots in names and long words change nothing."""
    long = "w" * 300
    rows = [(k, f"{long}{long} {long} +1 234 555 0{k:03d} soon", 1) for k in range(30)] + [(100, f"{long}{long} {long} 555-123-4567 soon", 2), (100, "a completely different text under the same id", 3), (None, f"{long}{long} {long} 555-123-4568 soon", 4), (None, None, 5), (None, "", 6)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int")
    hidden = {x["a.b"]: x.text for x in pii.masked(table).collect() if x["a.b"] > 1}
    assert hidden == {2: f"{long}{long} {long} <PHONE> soon", 3: rows[31][1], 4: f"{long}{long} {long} <PHONE> soon", 5: None, 6: ""}


def test_many_languages(spark):
    """No language is left out, however many there are."""
    rows = [(k, f"lang{k % 300:03d} " + " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 12)}{j}x" for j in range(9)), f"l{k % 300:03d}") for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = languages.fit(table, rows_per_language=3, centroids=1)
    assert len(model.languages) == 300


def test_groups_of_any_size(spark):
    """A row more or less changes no verdict by itself: groups of 79 and 80 rows are judged alike."""
    r = random.Random(31)
    text = lambda: " ".join(r.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) + str(r.randrange(99)) for _ in range(r.randrange(40, 200)))
    clean = [text() for _ in range(200)]
    verdicts = []
    for n in (79, 80):
        rows = [(k, clean[k], "en", "a") for k in range(n)] + [(200 + k, clean[199 - k], "en", "b") for k in range(90)] + [(900, " ".join(w + "##" for w in clean[0].split()), "en", "a")]
        found = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(n % 7 + 1)).collect()}
        assert not found[900].kept and all(found[k].kept for k in range(79))
        verdicts.append(found[900].distance)
    assert max(verdicts) < 1.3 * min(verdicts)


def test_outliers(spark):
    """In a large clean group, junk of several kinds is rejected and clean texts stay."""
    r = random.Random(13)
    clean = [" ".join(r.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) + r.choice(["", "", ",", "."]) + "xyz"[r.randrange(3)] * r.randrange(3) + str(r.randrange(99)) for _ in range(r.randrange(40, 400))) for _ in range(400)]
    junk = [" ".join(w + "***" for w in clean[k].split()) for k in range(20)] + [clean[k].upper() for k in range(20, 40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(clean + junk)]
    verdict = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert all(verdict[k] for k in range(400)) and not any(verdict[k] for k in range(400, 440))


@pytest.mark.parametrize("kind", ["length", "symbols", "lines", "repeats", "upper", "same"])
def test_outliers_by_one_statistic(spark, kind):
    """A text that is extreme in one statistic only is rejected."""
    r = random.Random(15)
    words = lambda n: [r.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) + str(r.randrange(99)) for _ in range(n)]
    lines = lambda n: "\n".join(" ".join(words(6)) for _ in range(n))
    long = [" ".join(words(8)) for _ in range(4)]
    junk = {
        "length": " ".join(w * 5 for w in words(100)), "symbols": " ".join(w + "##" for w in words(100)), "upper": lines(20).upper(),
        "lines": "\n".join(f"{' '.join(words(8))}\nRead more" for _ in range(20)), "repeats": "\n".join([long[0] + " " + " ".join(words(28)) + " " + long[0], lines(2)]), "same": " ".join(w for w in words(60) for _ in "12"),
    }[kind]
    rows = [(k, lines(r.randrange(8, 40)), "en", "s", 0) for k in range(300)] + [(300, junk, "en", "s", 0)]
    found = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert not found[300].base_failed and not found[300].kept and all(found[k].kept for k in range(300))


@pytest.mark.parametrize("share", [0.3, 0.45])
def test_outliers_of_a_skewed_source(spark, share):
    """Junk of nearly half a group is rejected, and the clean rest stays."""
    r = random.Random(14)
    texts = [" ".join(r.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) + str(r.randrange(99)) for _ in range(r.randrange(40, 400))) for _ in range(400)]
    junk = int(400 * share)
    rows = [(k, " ".join(w + "***" for w in t.split()) if k < junk else t, "en", "s", len(t)) for k, t in enumerate(texts)]
    verdict = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert not any(verdict[k] for k in range(junk)) and all(verdict[k] for k in range(junk, 400))


def test_slot_map_versions(spark, tmp_path):
    path = str(tmp_path / "maps")
    first = shards.SlotMap.even(3, 12)
    second = first.rebalanced({0: 9, 3: 9, 1: 1})
    shards.store(spark, [first, second], path)
    assert shards.load(spark, path) == second and shards.load(spark, path, 0) == first


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = languages.identify(table, languages.fit(table.where(~held)), extra=[F.col("lang"), held.alias("held")]).where("held")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


def pipeline_model(spark, rows):
    """What the stages before packing leave, from the rows that the quality stage kept."""
    classes = brute.near(rows)
    rows = [(k, t) for k, t in rows if classes[k][1] == k]
    seen, out = set(), []
    for key, text in sorted(rows):
        spans = [m.span() for m in brute.WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            block = tuple(words[k : k + 20])
            if block in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(block)
        out.append((key, [w for w, g in zip(words, gone) if not g]))
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    kept = [tuple(x) for x in first.select("doc_id", "text").collect()]
    verdict = {x.doc_id: x.kept for x in quality.judge(docs).collect()}
    assert {k for k, _ in kept} == {k for k, v in verdict.items() if v} and first.columns == docs.columns
    third = corpus_pipeline.repeated_passages(spark, corpus_pipeline.near_duplicates(spark, first, SF), SF)
    want = pipeline_model(spark, kept)
    assert sorted((x.doc_id, brute.WORD.findall(x.text)) for x in third.collect()) == want
    fourth = corpus_pipeline.personal_data(spark, third, SF)
    texts = {x.doc_id: x.text for x in fourth.collect()}
    assert fourth.columns == docs.columns and not any(brute.private(t) for t in texts.values())
    last = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id for x in last} == set(texts)
    tok = library("byte_bpe_50k.json")
    assert sum(x.length for x in last) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
