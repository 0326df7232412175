"""The document operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tasktide.llm import line_dedup
from tasktide.llm.decontaminate import Decontamination, _known, drop_contaminated
from tasktide.llm.language_id import LanguageId, keep_identified
from tasktide.llm.near_dedup import NearDedup, drop_near_duplicates, near_duplicates
from tasktide.llm.packing import Packing, pack
from tasktide.llm.queries import QUERIES, SQL
from tasktide.llm.tables import BATCH_BYTES, Workspace, shared_dir
from tasktide.llm.toxicity import PREFIXES, Toxicity, ToxicityModel
from tasktide.llm.words import ALNUM, NOT_SPACE, slices

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
ODD = [
    (1, None, None, None, None),
    (None, "no id at all here", "en", "a", 3),
    (2, "", "en", None, 0),
    (3, " \n\t ", "en", "a", 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "same line\nother line", "en", "a", 1),
    (5, "same line\nother line", "en", "a", 1),
    (6, "same line\nother line", "de", "a", 1),
    (7, "Éé ñ 中文 🙂", "fr", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with all defined cases, and extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in ("host", "lines", "n_lines", "score", "rejected", "bucket", "rep", "words", "shard", "key", "label", "found", "part", "spans")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_components(rows, shingle=2):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = frozenset(zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 80 * len(sets[b]) > 100 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_minhash_near_dedup"](spark, SF).collect()}
    assert got == brute_components(docs.select("doc_id", "text").collect())


def test_near_duplicates_that_stand_apart_from_the_centre(spark):
    """A chain of edits: neighbours are linked, ends are not; and blocks smaller than the cluster."""
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[k * 4 :] + [f"x{j}" for j in range(k * 4)])) for k in range(12)]
    rows += [(100 + k, " ".join([f"y{k}{j}" if j % 9 == k else w for j, w in enumerate(base)])) for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    for options in (NearDedup(shingle=2), NearDedup(shingle=2, block_shingles=300)):
        assert {r.doc_id: tuple(r)[1:] for r in options.classes(frame)[0].collect()} == expected


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd, 2).collect()]
    assert len(got) == len(ODD)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert got.count((5, 3, 5, True)) == 2 and (6, 3, 5, False) in got and (4, 1, 4, True) in got
    assert [g for g in got if g[0] is None] == [(None, 4, None, True)]
    kept = drop_near_duplicates(odd, 2)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_near_duplicates_with_ids_of_several_texts(spark):
    """Document 5 has three texts: of one 3 has a copy, of another 9; they are one component by it, and 7 is not in it."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(3, text["a"]), (5, text["a"]), (5, text["b"]), (5, text["c"]), (5, text["c"]), (9, text["b"] + " more"), (7, text["d"]), (7, "other words here"), (7, text["d"]), (8, None), (8, text["d"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for options in (NearDedup(shingle=2), NearDedup(shingle=2, block_shingles=30)):
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in options.classes(frame)[0].collect()}
        assert got == {(3, 39): (3, True), (5, 39): (3, False), (9, 40): (3, False), (7, 39): (7, True), (7, 2): (7, True), (8, 0): (8, True), (8, 39): (7, False)}
    kept = sorted(tuple(r) for r in drop_near_duplicates(frame, 2).collect())
    assert kept == sorted([(3, text["a"]), (7, text["d"]), (7, "other words here")])


def test_line_dedup_equals_sql(spark, odd, empty):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(map(repr, db.execute(SQL["op4_line_dedup"]).fetchall()))
    got = QUERIES["op4_line_dedup"](spark, SF).select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    assert got.filter("n_dropped > 0").count() > 0
    out = line_dedup.drop_boilerplate(odd, least=2, counts=("c", "d"))
    assert {(r.doc_id, r.text, r.c, r.d) for r in out.filter("doc_id in (1, 2, 6)").collect()} == {(1, None, 0, 0), (2, "", 1, 0), (6, "", 2, 2)}
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_line_dedup_counts_copies_of_a_text_once(spark, empty):
    rows = [(i, "menu\nonly here", "en", "a", 14) for i in range(5)] + [(10 + i, f"menu\nbody {i}", "en", "a", 11) for i in range(4)]
    rows += [(20 + i, "whole\ntext", "en", None, 10) for i in range(3)] + [(30 + i, None, "en", "a", None) for i in range(2)]
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert out == {
        **{i: ("only here", 9) for i in range(5)},
        **{10 + i: (f"body {i}", 6) for i in range(4)},
        **{20 + i: ("whole\ntext", 10) for i in range(3)},
        **{30 + i: (None, None) for i in range(2)},
    }
    # Of 6 different texts "menu" has 5; at a ratio of 0.83 that is still boilerplate, at 0.84 not.
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [line_dedup.boilerplate(frame, ratio=x, once=True).count() for x in (0.83, 0.84)] == [1, 0]
    assert line_dedup.drop_boilerplate(empty, once=True).count() == 0


def brute_contamination(docs, items):
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for i, text in items:
        w = word.findall(lower(text))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark, docs):
    got = sorted((tuple(r) for r in QUERIES["op5_decontamination"](spark, SF).collect()), key=repr)
    expected = brute_contamination(docs.select("doc_id", "text").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect())
    assert got == expected and any(r[-1] for r in got)


def test_decontamination_with_a_full_filter_and_a_shared_passage(spark):
    """A filter far too small lets much through and changes nothing; a passage that all items share names all of them."""
    shared = " ".join(f"s{i}" for i in range(13))
    items = [(i, f"{shared} own{i} more{i}") for i in range(60)]
    rows = [(i, f"before {shared} after") for i in range(30)] + [(100, f"{shared} own7 more7"), (101, "own7 more7"), (102, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for options in (Decontamination(), Decontamination(bits=3)):
        got = options.judged(docs, benchmark, lambda x: {"n": F.size(x), "sha": F.sha2(F.array_join(x, ",").cast("binary"), 256)})
        got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n", "sha", "contaminated").collect()), key=repr)
        assert got == brute_contamination(rows, items)


def test_filter_lets_little_through_however_large_the_benchmark():
    """A million shingles at 16 bits each, and what a table of ten million documents' words would pass."""
    rng = np.random.default_rng(1)
    h, other = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) for n in (1_000_000, 1_000_000))
    on = np.zeros(1 << 21, np.uint8)
    mask = np.uint64((1 << 24) - 1)
    for j in range(4):
        slot = (h & mask) + np.uint64(j) * ((h >> np.uint64(32) | np.uint64(1)) & mask) & mask
        np.bitwise_or.at(on, slot >> np.uint64(3), (1 << (slot & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    assert len(_known(on, h)) == len(h) and len(_known(on, other)) < 0.01 * len(other)


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = [(1, "same line"), (2, None), (3, "word word word"), (4, " ".join(f"v{i}" for i in range(20))), (4, " ".join(f"v{i}" for i in range(20))), (5, "É"), (30, "word WORD word"), (31, " ".join(f"v{i}" for i in range(20)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    rows = [*((r[0], r[1]) for r in ODD), (20, " ".join(f"V{i}" for i in range(2, 18))), (21, "x " + " ".join(f"v{i}" for i in range(12)))]
    frame = odd.unionByName(spark.createDataFrame([(*r, "en", "a", 1) for r in rows[-2:]], SCHEMA), allowMissingColumns=True)
    judged = Decontamination().judged(frame, benchmark)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    got = judged.select("doc_id", "n_words", "n_hit", F.size("items"), digest, "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_contamination(rows, items)
    kept = drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns and kept.count() == sum(not r.contaminated for r in got)
    assert drop_contaminated(frame, benchmark.limit(0)).count() == frame.count() and drop_contaminated(empty, benchmark).count() == 0


def test_language_id_is_right_on_held_out_rows(spark, docs):
    r = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert r.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98
    assert r.filter("score < 0 or score > 1").count() == 0


def test_language_id_of_odd_rows(spark, docs, odd, empty):
    model = LanguageId(sample=200).fit(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score, r.rejected) for r in model.predict(odd.select("doc_id", "text"), ["doc_id", "text"]).collect()}
    for key in ((1, None), (2, ""), (3, " \n\t ")):
        assert got[key] == ("und", 0.0, True)
    kept = keep_identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = LanguageId().fit(empty)
    assert {r.lang_pred for r in nothing.predict(odd.select("text"), ["text"]).collect()} == {"und"}
    assert model.predict(empty, ["doc_id"]).count() == 0
    signs = spark.createDataFrame([(1, "12 … € – 🙂"), (2, "12 … é"), (3, "中")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in model.predict(signs, ["doc_id"]).collect()} == {1: True, 2: False, 3: False}
    other = spark.createDataFrame([(1, "我们今天去公园散步，天气非常好，大家都很高兴。" * 20)], "doc_id long, text string")
    assert model.predict(other, ["doc_id"]).first().rejected


FOREIGN = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
)


def test_language_id_rejects_unlearned_languages_and_gibberish_but_no_clean_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = LanguageId().fit(docs.filter("doc_id % 2 = 0"))
    assert model.predict(docs.filter("doc_id % 2 = 1"), ["doc_id"]).filter("rejected").count() <= 1
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10)))
    junk = [" ".join(word() for _ in range(n)) for n in (10, 40, 150) for _ in range(20)] + [t[:n] for t in FOREIGN for n in (60, 1000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    assert model.predict(frame, ["doc_id"]).filter("rejected").count() >= 0.95 * len(junk)


def test_language_id_equals_brute_force(spark, docs):
    """Document frequencies, and the nearest centroid of each text, trigram by trigram."""
    options = LanguageId(sample=200, bits=10)
    train = docs.filter("doc_id % 3 > 0")
    model = options.fit(train)

    def grams(text):
        b = bytes(x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in text.encode())
        at = [((x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF for x, y, z in zip(b, b[1:], b[2:], strict=False) if y != 32]
        return Counter(h >> 22 for h in at)

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    df, n = Counter(), 0
    for r in train.filter("text is not null and lang is not null").collect():
        df.update(grams(r.text).keys())
        n += 1
    idf = [math.log((1 + n) / (1 + df[h])) + 0.1 for h in range(1024)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = {r.doc_id: r for r in model.predict(docs, ["doc_id"]).collect()}
    for i, text in rows:
        x = np.zeros(1024)
        for h, c in grams(text).items():
            x[h] = (1 + math.log(c)) * idf[h]
        s = model.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        assert abs(got[i].score - max(s.max(), 0)) < 1e-4 and s[[k for k, lang in enumerate(model.langs) if lang == got[i].lang_pred]].max() > s.max() - 1e-4


def test_sample_of_language_id_holds_repeated_rows_once(spark, docs):
    """A row that is most of the table is one row of the sample."""
    few = docs.filter("doc_id < 40").select("doc_id", "text", "lang")
    hot = few.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text again and again").alias("text"), F.lit("en").alias("lang")))
    model = LanguageId(sample=10_000).fit(hot)
    assert set(model.langs) == {r.lang for r in few.select("lang").distinct().collect()}
    plain = LanguageId(sample=10_000).fit(few)
    assert model.langs == plain.langs or len(model.langs) <= len(plain.langs) + 1


def test_toxicity_learns_terms_and_pairs(spark):
    rng = np.random.default_rng(1)
    plain = [f"p{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        w = list(rng.choice(plain, 12))
        a, b, c = (rng.random(3) < 0.3).tolist()
        w += ["insult"] * a + ["group"] * b + ["slur"] * c
        rows.append((i, " ".join(w)))
        labels.append((i, int((a and b) or c)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    model = Toxicity().fit(docs.filter("doc_id < 1000"), marks)
    got = {r.doc_id: r.score for r in model.score(docs, ["doc_id"]).collect()}
    held = [(got[i], y) for i, y in labels if i >= 1000]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97


@pytest.mark.parametrize("n", [1000, 20_000])
def test_toxicity_learns_what_no_additive_model_can(spark, n):
    """Each of two words alone is toxic, both together are not; as shipped, on few and on many rows."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n + 2000):
        a, b = (rng.random(2) < 0.3).tolist()
        rows.append((i, " ".join([*(f"p{k}" for k in rng.integers(0, 200, 12)), *["insult"] * a, *["group"] * b])))
        labels.append((i, int(a != b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    model = Toxicity().fit(docs, marks.filter(F.col("doc_id") < n))

    def right(model):
        got = {r.doc_id: r.score for r in model.score(docs.filter(F.col("doc_id") >= n), ["doc_id"]).collect()}
        return np.mean([(got[i] >= 0.5) == y for i, y in labels[n:]])

    assert right(model) > 0.97 and right(replace(model, factors=model.factors * 0)) < 0.95


def test_factors_that_do_not_help_go(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"p{k}" for k in rng.integers(0, 100, 12))) for i in range(1000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(rng.random() < 0.3)) for i in range(1000)], "doc_id long, label int")
    assert not Toxicity().fit(docs, marks).factors.any()


def test_toxicity_scores_equal_brute_force(spark, docs):
    """Sums over terms and over all pairs of terms, on texts of the sample table and with factors everywhere."""
    rows = docs.select("doc_id", "text").limit(60).collect()
    known = sorted({int(h) for r in rows for _, _, t in slices(pa.array([r.text], pa.string())) for h in t.lower().terms(ALNUM, PREFIXES)[0][::7]})
    rng = np.random.default_rng(4)
    w, v, bias = rng.normal(0, 0.05, len(known)), rng.normal(0, 0.05, (len(known), 3)), -0.3
    at = {h: i for i, h in enumerate(known)}
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(-1, None), (-2, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ToxicityModel(np.array(known, np.uint64), w, v, bias).score(frame, ["doc_id"]).collect()}
    for r in frame.collect():
        mine = sorted({at[int(h)] for _, _, t in slices(pa.array([r.text], pa.string())) for h in t.lower().terms(ALNUM, PREFIXES)[0] if int(h) in at})
        total = bias + sum(w[i] for i in mine) + sum(float(v[i] @ v[k]) for n, i in enumerate(mine) for k in mine[:n])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (4, 0), (None, 1), (7, None)], "doc_id long, label int")
    model = Toxicity().fit(odd, labels)
    assert model.score(odd, ["doc_id"]).filter("score between 0 and 1").count() == len(ODD)
    one = Toxicity().fit(odd, labels.filter("label = 1"))
    assert one.score(odd, ["doc_id"]).filter("score > 0.99").count() == len(ODD)
    assert Toxicity().fit(empty, labels).score(odd, ["doc_id"]).filter("score < 0.01").count() == len(ODD)
    assert model.score(empty, ["doc_id"]).count() == 0


def brute_pieces(rows):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(Packing().tokenizer), []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            a = np.array(ids[k : k + 4096], "<u4")
            out.append((i, k // 4096, k, len(a), zlib.crc32(a.tobytes())))
    return sorted(out, key=repr)


def test_packing_has_the_right_pieces_in_few_sequences(spark, docs, odd, empty):
    text = "It's 12 <|endoftext|> of X²'s Straße, é ’quoted’ don't,stop..and\x0bgo"
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(r[0], r[1]) for r in ODD] + [(900, text)]
    frame = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(900, text)], "doc_id long, text string"))
    got = Packing().sequences(frame).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_pieces(rows)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096 and len(sequences) <= 1.03 * sum(sequences.values()) / 4096 + 1
    assert Packing().sequences(empty).count() == 0


def test_pack_places_by_sums_of_squares():
    assert [x.tolist() for x in pack(np.array([6, 5, 4, 5]), 10)] == [[0, 1, 0, 1], [0, 0, 6, 5]]
    assert [x.tolist() for x in pack(np.array([10, 10]), 10)] == [[0, 1], [0, 0]]


def test_words_of_sliced_columns():
    column = pa.array(["skip", "a bb", None, "", "é x\ty"]).slice(1)
    for most in (1, 4, 100):
        words = [int(n) for _, _, t in slices(column, most) for n in np.diff(t.words(NOT_SPACE).first)]
        assert words == [2, 0, 0, 3]


def test_pipeline_equals_brute_force(spark):
    """The last stages' decisions, each on what the stage before kept."""
    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, SF).persist()
        kept[name] = (before, frame)
        assert frame.columns == before.columns
    before, after = kept["near_dedup"]
    expected = brute_components(before.select("doc_id", "text").collect(), 5)
    assert {r.doc_id for r in after.collect()} == {i for i, x in expected.items() if x[2]}
    before, after = kept["decontaminate"]
    bad = {r[0] for r in brute_contamination(before.select("doc_id", "text").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()) if r[-1]}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    pieces = brute_pieces([tuple(r) for r in after.select("doc_id", "text").collect()])
    out = corpus_pipeline.run(spark, SF)
    assert sorted((tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr) == pieces


def test_pipeline_of_odd_rows_and_clashing_columns(spark, docs, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and extra columns go through all stages; texts without a language go."""
    extra = ("n_lines", "n_dropped", "__lines", "doc", "fingerprint", "items", "piece", "length", "start", "offset", "sequence_id", "component_id", "kept", "lang_pred", "set_a", "count")
    clean = docs.filter("doc_id >= 100").withColumn("doc_id", F.col("doc_id") + 1000)
    again = clean.limit(3).collect()
    frame = odd.unionByName(clean.unionByName(spark.createDataFrame(again, clean.schema)), allowMissingColumns=True).withColumns({c: F.lit(1) for c in extra if c != "__lines"})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage as this in any of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, step = step.columns, stage(spark, step, str(tmp_path)).persist()
        assert step.columns == columns
    kept = [tuple(r) for r in step.select("doc_id", "text").collect()]
    ids = [i for i, _ in kept]
    assert {1, 2, 3, 6}.isdisjoint(ids) and len(ids) == len(set(ids)) and {r.doc_id for r in again} & set(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_pieces(kept)


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_cluster_has_to_name_a_shared_folder():
    class Session:
        class conf:
            settings = {"spark.master": "spark://host:7077"}
            get = settings.get

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
    Session.conf.settings["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(Session()) == "hdfs://x/y"


def test_rows_go_to_python_in_batches_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    def groups(group):
        return pa.table({"rows": [group.num_rows]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, work = spark.conf.get(key), Workspace(spark, "batches")
    docs = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("ab "), 10_000).alias("text"))
    got = work.keep(docs.select("text").mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in got) == 400 and max(r.bytes for r in got) < 2 * BATCH_BYTES
    whole = docs.groupBy((F.col("id") % 2).alias("k")).applyInArrow(groups, "rows long")
    assert [r.rows for r in work.keep(whole, "groups").collect()] == [200, 200]
    assert spark.conf.get(key) == before
    with pytest.raises(Exception, match="exists"):
        work.keep(docs, "sizes")
    assert spark.conf.get(key) == before
