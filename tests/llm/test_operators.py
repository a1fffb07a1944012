"""Each operator against brute force on small fixtures, with nulls, empty and repeated rows, hot groups, and clashing extra columns."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonegrid.llm import bpe, chunking, cooccurrence, frequency, mixing, mojibake, neardup, packing, spans

RECORD = ["score_id", "seq_id"]
SCHEMA = "score_id bigint, seq_id int, ids array<int>, n string, rec string, route int"


@pytest.fixture(autouse=True, params=[10_000, 7])
def batch_rows(request, spark):
    """Python sees whole partitions in one batch, or few rows at a time: groups then go on from batch to batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def records(spark, rows):
    """rows: (score_id, seq_id, ids); each comes twice, with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", i) for i, r in enumerate(rows * 2)], SCHEMA)


def test_last_seen_counts(spark):
    rows = [(1, 0, ["a", "b", "a", None]), (1, 1, ["a"]), (2, 0, None), (2, 1, []), (None, 1, ["c", "c"])]
    df = spark.createDataFrame(rows, "score_id bigint, seq_id int, tokens array<string>")
    got = {tuple(r) for r in frequency.of_lists(df, "tokens").collect()}
    assert got == {("a", 3, 2), ("b", 1, 1), ("c", 2, 1), (None, 0, 3)}
    long = [(s, q, i, t) for s, q, ts in rows for i, t in enumerate(ts or [])] * 2
    df = spark.createDataFrame(long, "score_id bigint, seq_id int, ord int, term string")
    assert {tuple(r) for r in frequency.of_rows(df, RECORD, "ord", "term").collect()} == {("a", 3, 2), ("b", 1, 1), ("c", 2, 1)}
    assert frequency.of_rows(df.limit(0), RECORD, "ord", "term").count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([("f", "a", 9, 9), ("f", "b", 2, 2), ("f", "c", 5, 5)], "field string, term string, occurrences bigint, records bigint")
    total = spark.createDataFrame([("f", 10)], "field string, n_records bigint")
    assert {(r.term, r.mark) for r in frequency.marked(counts, total, 3, 0.8).collect()} == {("a", "common"), ("b", "rare"), ("c", "useful")}


@pytest.mark.parametrize("dense", [2048, 2])
def test_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(cooccurrence, "DENSE", dense)
    rnd = random.Random(3)
    rows = [(i, 0, rnd.choices(range(9), k=rnd.randrange(7))) for i in range(60)] + [(100 + i, 0, [1, 2, 3]) for i in range(40)] + [(200, 0, None), (None, 1, [5, None, 6]), (7, None, [5, 6])]
    baskets = [set(ids) - {None} for _, _, ids in rows if ids]
    exp = Counter((a, b) for s in baskets for a, b in itertools.combinations_with_replacement(sorted(s), 2))
    got = {(r.id_a, r.id_b): r.n for r in cooccurrence.pair_counts(records(spark, rows), RECORD, "ids").collect()}
    assert got.pop((None, None)) == len(baskets)
    assert got == exp
    scored = cooccurrence.scored(cooccurrence.pair_counts(records(spark, rows), RECORD, "ids")).where("id_a = 1 and id_b = 2").first()
    assert scored.lift == pytest.approx(exp[1, 2] * len(baskets) / exp[1, 1] / exp[2, 2])
    assert not any(r.n for r in cooccurrence.pair_counts(records(spark, rows).limit(0), RECORD, "ids").collect())


def brute_pieces(ids, most, overlap, bar):
    start, out = 0, []
    while len(ids) - start > most:
        n = next((k for k in range(most, overlap, -1) if ids[start + k] == bar), most)
        out.append((start, start + n - 1))
        start += n - overlap
    return [*out, (start, len(ids) - 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=80), st.integers(3, 12), st.integers(0, 2))
def test_pieces(ids, most, overlap):
    cuts = np.flatnonzero(np.array(ids) == 0)
    assert chunking.pieces(len(ids), most, overlap, cuts[cuts > 0]) == brute_pieces(ids, most, overlap, 0)


def test_split(spark):
    ids = [4 if i % 7 == 0 else 100 + i % 5 for i in range(50)]
    rows = [(1, 0, ids), (1, 1, ids[:10]), (2, 0, None), (2, 1, []), (None, 3, [None] * 25)]
    got = chunking.split_oversized(records(spark, rows), RECORD, "ids", [("a", 20, 4)], 4, False).collect()
    exp = [("a", 1, 0, i + 1, a, b) for i, (a, b) in enumerate(brute_pieces(ids, 20, 4, 4))]
    exp += [("a", None, 3, i + 1, a, b) for i, (a, b) in enumerate(brute_pieces([None] * 25, 20, 4, 4))]
    assert sorted(map(tuple, got), key=str) == sorted(exp, key=str)
    by_cohesion = chunking.split_oversized(records(spark, rows), RECORD, "ids", [("a", 20, 4)], 4, True).where("score_id = 1").orderBy("piece_no").collect()
    assert all(r.last_pos - r.first_pos < 20 for r in by_cohesion) and by_cohesion[-1].last_pos == 49
    with pytest.raises(ValueError):
        chunking.split_oversized(records(spark, rows), RECORD, "ids", [("a", 4, 4)], 4)


def test_cohesion_finds_the_change():
    ids = np.array(([0, 1, 2, 3] * 6) + ([0, 7, 8, 9] * 6))
    cuts = np.arange(4, len(ids), 4)
    assert cuts[np.argmax(chunking.cohesion(ids, cuts))] == 24


def brute_spans(rows, least):
    where = defaultdict(set)
    for key, ids in rows.items():
        for i in range(len(ids) - least + 1):
            where[tuple(ids[i : i + least])].add(key)
    out = set()
    for key, ids in rows.items():
        covered = [False] * (len(ids) + 1)
        for i in range(len(ids) - least + 1):
            if len(where[tuple(ids[i : i + least])]) > 1:
                covered[i : i + least] = [True] * least
        edges = [i for i in range(len(ids) + 1) if covered[i] != (covered[i - 1] if i else False)]
        out |= {(*key, a, b - 1) for a, b in zip(edges[::2], edges[1::2])}
    return out


@pytest.mark.parametrize("least", [2, 5, 10])
def test_spans(spark, least):
    rnd = random.Random(least)
    common = [rnd.choices(range(50), k=30) for _ in range(4)]
    rows = {}
    for i in range(60):
        ids = []
        for _ in range(rnd.randrange(4)):
            ids += rnd.choices(range(50), k=rnd.randrange(12))
            c = rnd.choice(common)
            a = rnd.randrange(len(c))
            ids += c[a : a + rnd.randrange(20)]
        rows[i, 0] = ids
    rows |= {(100 + i, 0): [1] * (i + 3) for i in range(20)}  # a hot passage
    rows[300, 0] = [70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80] * 3  # only repeats itself
    df = records(spark, [(*k, v) for k, v in rows.items()] + [(400, 0, None), (401, None, [70000, -5] * 20)])
    rows[401, None] = [70000, -5] * 20
    assert {tuple(r) for r in spans.shared_spans(df, RECORD, "ids", least).collect()} == brute_spans(rows, least)
    assert spans.shared_spans(df.limit(0), RECORD, "ids", least).count() == 0


def test_coverage(spark):
    df = records(spark, [(1, 0, list(range(20))), (2, 0, list(range(10, 30))), (3, 0, []), (4, 0, [1])])
    got = {r.score_id: (r.n_ids, r.n_shared) for r in spans.coverage(df, spans.shared_spans(df, RECORD, "ids", 5), RECORD, "ids").collect()}
    assert got == {1: (20, 10), 2: (20, 10), 3: (0, 0), 4: (1, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_pack(sizes):
    sizes = np.array(sizes)
    box = packing.pack(sizes, 50)
    sums = np.bincount(box, weights=sizes)
    assert sums.max() <= 50 and (sums > 0).all()


def test_packing_is_tight():
    sizes = np.random.default_rng(1).integers(1, 400, 1000)
    assert len(np.unique(packing.pack(sizes, 512))) <= 1.06 * -(-sizes.sum() // 512)
    assert set(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == {16, 14}


def test_rows(spark):
    rows = [(i, 0, i * 7 % 90) for i in range(1, 200)] + [(500, 0, 250), (501, 0, None), (502, 0, 0), (None, 1, 30)]
    df = spark.createDataFrame(rows, "score_id bigint, seq_id int, size int")
    got = packing.fill_rows(df, RECORD, "size", [("a", 100), ("b", 64)], 2).collect()
    for name, capacity in (("a", 100), ("b", 64)):
        own = [r for r in got if r.config_name == name]
        ids = Counter()
        for r in own:
            ids[r.score_id, r.seq_id] += r.n_ids
        assert ids == {(s, q): n for s, q, n in rows if n}
        filled = Counter()
        for r in own:
            filled[r.row_id] += r.n_ids
        assert max(filled.values()) <= capacity and all(filled[r.row_id] == r.row_ids == capacity - r.padding for r in own)
        assert all(Counter((r.score_id, r.seq_id) for r in own)[s, q] == 1 for s, q, n in rows if n and n <= capacity)


def test_near_duplicates(spark):
    rnd = random.Random(1)
    base = [rnd.choices(range(300), k=80) for _ in range(20)]
    rows = []
    for i in range(120):
        ids = list(rnd.choice(base))
        for _ in range(rnd.randrange(8)):
            ids[rnd.randrange(len(ids))] = rnd.randrange(300)
        rows.append((i, rnd.randrange(2), ids))
    rows += [(1000 + i, 0, base[0]) for i in range(30)]  # copies
    rows += [(2000, 0, [1, 2]), (2001, 0, []), (2002, 0, None), (2003, 0, [None] * 9), (2004, 0, [None] * 9), (None, 0, base[0])]
    sets = {(s, q): frozenset(tuple(ids[j : j + 4]) for j in range(len(ids) - 3)) for s, q, ids in rows if ids and s is not None}
    exp = set()
    for a, b in itertools.combinations(sorted(k for k, v in sets.items() if v), 2):
        both = len(sets[a] & sets[b])
        if both * 5 >= 3 * (len(sets[a]) + len(sets[b]) - both):
            exp.add(("s", *a, *b))
    df = records(spark, rows).select(F.lit("s").alias("kind"), F.lit(4).alias("k"), "score_id", F.col("seq_id").alias("idx"), "ids", "n", "rec")
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == exp
    assert neardup.similar_pairs(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder()


@pytest.fixture(scope="module")
def reference_encoding():
    import base64

    import tiktoken

    with open(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é'st  \n\t\r1.—平  <|>Ж"), max_size=40))
def test_encoding_is_that_of_the_tokenizer(encoder, reference_encoding, text):
    assert np.frombuffer(encoder(text), np.int32).tolist() == reference_encoding.encode_ordinary(text)


def test_prefix_tables(encoder):
    e = encoder.alone.encoder
    text = "unbelievable storytelling".encode()
    table = e.extend(text, [])
    assert e.extend(text, e.extend(text[:7], []), 7) == table
    assert all(e.read(table, i) == e.encode(text[:i]) for i in range(1, len(text) + 1))
    assert e.edit(text, table, b"unbelievably") == e.extend(b"unbelievably", [])


def test_ids(spark, reference_encoding):
    rows = [(1, "a word"), (2, ""), (3, None), (4, "x" * 20000 + " <|endoftext|> \n\n y"), (None, " "), (1, "a word")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), reference_encoding.encode_ordinary(t or "")) for k, t in rows)


def test_water_fill():
    plan = mixing.water_fill({"a": 100, "b": 800, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 4, "c": 3})
    assert plan["a"] == (2.0, True, True) and plan["c"][1]
    assert plan["b"][0] == pytest.approx(700 / 800)
    assert mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 1})["a"] == (1.0, False, False)


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "a" if i % 4 else "b") for i in range(400)] + [(900, None, "a"), (901, "x", None), (902, "x", "z")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.source_plan(docs, targets).cache()
    by = {r.source: r for r in plan.collect()}
    assert by["none"].n_tokens == 0 and not by["none"].short and by["b"].repeats == pytest.approx(2.0, rel=0.02)
    mix = mixing.mixture(docs, plan)
    n = {r.source: r["sum(copies)"] for r in mix.groupBy("source").sum("copies").collect()}
    assert n["b"] == pytest.approx(200, abs=25) and n["a"] == pytest.approx(200, abs=30)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.mixture(docs.repartition(7), plan).collect()))
    assert mixing.source_plan(docs, targets.limit(0)).count() == 0
    assert mixing.source_plan(docs.limit(0), targets).where("n_tokens = 0").count() == 3


CLEAN = {
    "fr": "La cour a jugé que l’acceptation du dépôt était régulière et que la créance, née à Orléans, a été réglée.",
    "de": "Der Kläger trägt vor, die Übergabe sei für ihn möglich gewesen; das Gericht hält dies für unerheblich.",
    "pl": "Sąd uznał, że służebność nie wygasła, a świadek zeznał prawdę; żądanie kwoty jest bezzasadne, późniejsze też.",
    "ru": "Суд полагает, что право стока не прекращается одним лишь неиспользованием, и ответчик этого не отрицает.",
}


def garbled(text, right, wrong):
    out = []
    for b in text.encode(right, "replace"):
        out.append(bytes([b]).decode(wrong, "ignore") or chr(b))
    return "".join(out)


def test_garbled_texts(spark):
    rnd = random.Random(5)
    rows, exp = [], {}
    for i in range(600):
        lang = rnd.choice(list(CLEAN))
        words = CLEAN[lang].split(" ")
        start = rnd.randrange(4)
        rows.append((i, " ".join(words[start:]), f"s{i % 3}"))
    kinds = [("fr", "utf-8", "cp1252"), ("de", "utf-8", "mac_roman"), ("ru", "cp1251", "cp1252"), ("pl", "cp1250", "cp1252"), ("ru", "koi8-r", "cp1251"), ("fr", "utf-8", "cp437")]
    for j, (lang, right, wrong) in enumerate(kinds * 2):
        text = CLEAN[lang]
        rows.append((1000 + j, garbled(text, right, wrong) if j < 6 else text[:30] + garbled(text[30:], right, wrong), "s1"))
        exp[1000 + j] = text
    rows += [(2000, "Le d�p�t", "s1"), (2001, None, None), (2002, "", "s0"), (2003, "plain", "s0"), (2004, "½ × ±3 µm", "s0"), (2005, "CAFÉ 平成 ☂️", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key", F.lit(0)).withColumn("bucket", F.lit("x"))
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert set(got) == set(exp) | {2000}
    assert got[2000].ciphers == ["lost"]
    right = sum(got[k].restored == v.encode("cp1250", "replace").decode("cp1250") or got[k].restored == v or sum(a != b for a, b in zip(got[k].restored, v)) < 4 for k, v in exp.items())
    assert right >= 10
    assert mojibake.repair(df.limit(0)).count() == 0


def test_swaps_are_inverse():
    text = CLEAN["ru"]
    assert mojibake.undo(garbled(text, "cp1251", "koi8-r"), ("cp1251", "koi8-r")) == text
    assert mojibake.undo(garbled(garbled(text, "utf-8", "cp1252"), "utf-8", "cp1252"), ("utf-8", "cp1252+cp1252")) == text


@pytest.mark.parametrize("block", [4096, 20])
def test_near_duplicates_in_a_hot_band(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(4)
    base = rnd.choices(range(300), k=60)
    rows = []
    for i in range(90):  # all alike, all different: every band is hot
        ids = list(base)
        ids[rnd.randrange(60)] = 1000 + i
        rows.append((i, 0, ids))
    sets = {s: {tuple(ids[j : j + 4]) for j in range(57)} for s, _, ids in rows}
    alike = {(a, b) for a, b in itertools.combinations(range(90), 2) if len(sets[a] & sets[b]) * 5 >= 3 * len(sets[a] | sets[b])}
    df = records(spark, rows).select(F.lit("s").alias("kind"), F.lit(4).alias("k"), "score_id", F.col("seq_id").alias("idx"), "ids")
    got = [(r.score_a, r.score_b) for r in neardup.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == alike
    links = Counter(x for pair in alike for x in pair)
    copies = df.union(df.where("score_id < 3").withColumn("score_id", F.col("score_id") + 500))
    for r in neardup.linked(copies).collect():
        s, twice = r.score_id % 500, sum(1 for t in range(3) if (min(r.score_id % 500, t), max(r.score_id % 500, t)) in alike)
        assert (r.class_score, r.n_copies) == (s, 2 if s < 3 else 1) and r.n_links == links[s] + twice + (s < 3)


def test_gathered(spark):
    rnd = random.Random(2)
    rows = [(s, t, o, rnd.randrange(100)) for s in range(4) for t in range(3) for o in range(rnd.randrange(12))]
    rows += [(9, 0, 5, 2), (9, 0, 5, 1), (None, 0, 1, 1), (9, None, 1, 1), (9, 0, None, 1), (9, 0, 1, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows * 2], "score_id bigint, track_idx int, ord bigint, pitch int, _v string")
    exp = defaultdict(set)
    for s, t, o, p in rows:
        if None not in (s, t, o, p):
            exp[s, t].add((o, p))
    got = {(r.score_id, r.track_idx): r.ids for r in neardup.gathered(df, ["score_id", "track_idx"], "ord", "pitch").collect()}
    assert got == {k: [p for _, p in sorted(v)] for k, v in exp.items()}
    assert neardup.gathered(df.limit(0), ["score_id", "track_idx"], "ord", "pitch").count() == 0


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_gray_index(n):
    from tonegrid.llm.graycode import GrayIndex, gray_rank

    rng = np.random.default_rng(n)
    bits = rng.integers(0, 1 << 63, size=(max(1, n // 10), 2), dtype=np.uint64)[rng.integers(0, max(1, n // 10), n)]
    for i in range(n):
        for k in rng.integers(0, 128, 20):
            bits[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
    for limit in (0, 10, 44):
        got = [tuple(sorted(p)) for x, y in GrayIndex(bits).pairs(limit) for p in zip(x.tolist(), y.tolist())]
        assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if far[i, j] <= limit]
        across = {(i, j) for x, y in GrayIndex(bits).pairs(limit, bits[::2]) for i, j in zip(x.tolist(), y.tolist())}
        assert across == {(i, j) for i in range((n + 1) // 2) for j in range(n) if far[2 * i, j] <= limit}
    assert all(gray_rank(np.array([[i ^ (i >> 1)]], np.uint64))[0, 0] == i for i in range(64))


def test_every_source_learns_for_itself(spark):
    """More than 64 sources, each with the ciphers of its own; and a run of more than 40 characters, restored whole."""
    pages = [("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1252"), ("fr", "utf-8", "cp1252"), ("pl", "cp1250", "cp1252")]
    rows, exp = [], {}
    for i in range(100):
        lang, right, wrong = pages[i % 4]
        rows += [(10 * i + j, f"{CLEAN[x]} {CLEAN[x]}"[j:], f"s{i}") for j, x in enumerate([*CLEAN, lang])]
        rows.append((10 * i + 9, garbled(CLEAN[lang], right, wrong), f"s{i}"))
        exp[10 * i + 9] = CLEAN[lang]
    long = CLEAN["ru"].replace(" ", "").replace(",", "").replace(".", "") * 3
    rows += [(5000, long, "s1"), (5001, garbled(long, "utf-8", "cp1252"), "s1")]
    exp[5001] = long
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert set(got) == set(exp)
    whole = sum(got[k].restored == v for k, v in exp.items())
    assert got[5001].restored == long and whole >= 0.7 * len(exp), whole


def test_what_no_page_has_ends_a_run():
    assert mojibake.windows("a平é") == ["平é "] and mojibake.windows("平成") == []


def test_shares_are_those_of_the_documents_drawn(spark):
    from tonegrid.functions import uniform

    rnd = random.Random(8)
    docs = [(i, "word " * rnd.randrange(1, 40), rnd.choice("aab")) for i in range(300)] + [(900, None, "a"), (901, "", "b"), (902, "x", None), (903, "x", "other")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("copies", F.lit(7))
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(df, targets)
    shares = {r.source: r for r in shares.collect()}
    u = {r.doc_id: r.u for r in df.select("doc_id", uniform(1, "doc_id").alias("u")).collect()}
    tokens = {r.doc_id: r.n for r in bpe.encode(df).select("doc_id", F.size("ids").alias("n")).collect()}
    exp, used = {}, Counter()
    for key, _, source in docs:
        if source in shares:
            repeats = shares[source].repeats
            copies = min(int(repeats) + (u[key] < repeats - int(repeats)), shares[source].max_repeats)
            used[source] += copies * tokens[key]
            if copies:
                exp[key] = (source, copies)
    assert {r.doc_id: (r.source, r.copies) for r in mix.collect()} == exp
    for source, r in shares.items():
        assert r.used_tokens == used[source] and r.reached_share == pytest.approx(used[source] / sum(used.values()))
    assert shares["a"].reached_share == pytest.approx(shares["a"].planned_share, abs=0.05)
    assert {r.reached_share for r in mixing.mixed(df.limit(0), targets)[1].collect()} == {0.0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_best_fit(sizes):
    box = packing.best_fit(np.array(sizes), 50)
    assert np.bincount(box, weights=sizes).max() <= 50
    assert packing.pack(np.array(sizes), 50).max() <= box.max()


def test_pieces_advance_by_half_of_their_reach():
    cuts = np.arange(5, 600, 5)
    depth = np.where(cuts % 100 == 10, 5.0, 0.1)  # deep valleys early in each window
    made = chunking.pieces(600, 100, 8, cuts, depth)
    assert all(b - a + 1 >= 8 + 46 for a, b in made[:-1]) and made[-1][1] == 599
