import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.config import Display, MediaLane, candidate_k, clamp_limit
from lodestone.errors import BadRequest, DimMismatch, PathNotIndexed, TextNotAMediaFilter, TooManyMediaTypes, envelope
from lodestone.functions import porter, scoring, text, vectors
from lodestone.operators import retrieval as R
from lodestone.operators import search as S
from lodestone.plans import catalog


def one(spark, **columns):
    """A one-row frame's values of expressions."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_limits():
    assert [clamp_limit(n) for n in (0, 1, 100)] == [10, 1, 50]
    assert candidate_k(3) == 30 and candidate_k(45) == 45


def test_normalised_scores(spark):
    pairs = [((1, 1), 1.0), ((1, None), 0.55), ((None, 1), 0.45), ((10, 10), 0.55), ((20, 20), 11 / 30), ((None, None), 0.0)]
    rows = spark.createDataFrame([p for p, _ in pairs], "v int, b int").select(scoring.normalized(F.col("v"), F.col("b"), Display()).alias("s")).collect()
    assert [r[0] for r in rows] == pytest.approx([s for _, s in pairs])


def test_fusion(spark):
    v = spark.createDataFrame([(7, 1), (1, 2), (2, 3)], "chunk_id long, v_rank long")
    b = spark.createDataFrame([(7, 1), (3, 2), (4, 3)], "chunk_id long, b_rank long")
    rows = R.fuse(v, b).orderBy(F.desc("score_rrf"), "chunk_id").collect()
    assert [r.chunk_id for r in rows] == [7, 1, 3, 2, 4]
    assert rows[0].score_rrf == pytest.approx(2 / 61)
    assert (rows[1].v_rank, rows[1].b_rank) == (2, None)


@pytest.mark.parametrize(
    ("results", "candidates", "limit", "slots", "expected"),
    [
        ([(i, "text") for i in range(1, 9)], [91, 92], 8, 4, [1, 2, 3, 91, 4, 5, 6, 92]),
        ([(i, "text") for i in range(1, 9)], [99], 8, 2, [1, 2, 3, 4, 5, 6, 7, 99]),
        ([(i, "image") for i in range(1, 8)] + [(8, "text")], [91, 92, 93, 94], 8, 4, [1, 2, 3, 4, 5, 6, 7, 91]),
        ([(1, "text")], [1], 8, 4, [1]),
        ([], [5, 6], 4, 2, [5, 6]),
    ],
)
def test_media_lane(spark, results, candidates, limit, slots, expected):
    kind = "array<struct<chunk_id:long,media_type:string>>"
    row = spark.createDataFrame([(results, [(c, "image") for c in candidates])], f"r {kind}, c {kind}")
    got = row.select(R.interleave(F.col("r"), F.col("c"), limit, slots).alias("x")).first()[0]
    assert [x.chunk_id for x in got] == expected


def test_gate_compares_floats(spark):
    lane = MediaLane(enabled=True)
    rows = spark.createDataFrame([(0.40, "image"), (0.400001, "image"), (0.45, "pdf"), (0.450001, "pdf"), (0.1, "text")], "d float, m string")
    assert [r[0] for r in rows.select(scoring.gate(F.col("d"), F.col("m"), lane)).collect()] == [True, False, True, False, False]


def test_lane_settings():
    with pytest.raises(ValueError):
        MediaLane(fraction=1.5)
    with pytest.raises(ValueError):
        MediaLane(best_image=0.6)
    with pytest.raises(ValueError):
        Display(weight_vec=0.9, weight_bm25=0.9)


def test_query_strings(spark):
    r = one(spark, a=text.match_query(F.lit("rust-lang (sqlite)")), b=text.match_query(F.lit("a b c")), c=text.match_query(F.lit("é x_")))
    assert (r.a, r.b, r.c) == ('"rust-lang" "sqlite"', "", '"é" "x_"')


def test_snippets(spark):
    cases = {
        "# Title\nbody  text\n": "body text", "#only": "only", "plain": "plain", "x" * 240: "x" * 240, "x" * 241: "x" * 237 + "...",
        "y" * 239 + "  ": "y" * 237 + "...", "y" * 239 + " ": "y" * 239, "": "", "a  b": "a b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select(text.snippet(F.col("c"))).collect()
    assert [r[0] for r in rows] == list(cases.values())


def test_titles_and_tags(spark):
    r = one(
        spark, a=text.title(F.lit("x/a.tar.gz")), b=text.title(F.lit(".hidden")), c=text.media_snippet(F.lit("pdf"), F.lit(0), F.lit(1)), d=text.media_snippet(F.lit("pdf"), F.lit(2), F.lit(5)),
        e=text.media_tag(F.lit("pdf"), F.lit(2), F.lit(5), F.lit(True)), f=text.media_snippet(F.lit("pdf"), F.lit(3), F.lit(1)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("a.tar", ".hidden", "PDF page 1", "PDF pages 3–5", "[pdf p3-5 truncated]", "PDF")


def test_page_ranges(spark):
    r = one(spark, a=text.page_ranges(F.lit(5), F.lit(2)), b=text.page_ranges(F.lit(0), F.lit(2)))
    assert [tuple(x) for x in r.a] == [(0, 2), (2, 4), (4, 5)] and r.b == []


def test_media_ties_and_filters(spark):
    vecs = spark.createDataFrame([(i, [0.5, 0.0]) for i in range(6, 0, -1)], "chunk_id long, embedding array<float>")
    chunks = vecs.select("chunk_id", F.lit("image").alias("media_type"))
    assert [r.chunk_id for r in R.knn_media(vecs, chunks, R.literal([1, 0]), 5).collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(TooManyMediaTypes):
        R.knn_media(vecs, chunks, R.literal([1, 0]), 0, ["image"] * 5)
    with pytest.raises(TextNotAMediaFilter):
        R.knn_media(vecs, chunks, R.literal([1, 0]), 0, ["text"])
    with pytest.raises(BadRequest):
        R.request_media_types(False, ["image"])
    with pytest.raises(BadRequest):
        R.request_media_types(True, ["Image"])
    assert R.request_media_types(True, ["pdf", "image", "pdf"]) == ["pdf", "image"]


def test_centroid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [9.0])], "g int, embedding array<double>")
    r = vectors.centroid(v, ["g"], dim=2).select(vectors.normalised(F.col("centroid")).alias("v")).first()
    assert r.v == pytest.approx([math.sqrt(0.5)] * 2)


CORPUS = ["the cat sat on the mat", "cat cat cat", "running runs runner ran", "Ünïcödé café CAT", "hopping hoped, rational relational generalizations", "under_score rust-lang", "nothing here", "the mat-cat mat cat"]


@pytest.mark.parametrize("asked", ["cat", "the mat", "running", "cafe", "rust-lang", "mat-cat", "relational", "-- cat", "zzz"])
def test_bm25_is_that_of_fts5(spark, asked):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, heading_path, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, content, heading_path) VALUES (?, ?, ?)", [(i + 1, c, "cat" if i == 2 else "") for i, c in enumerate(CORPUS)])
    query = one(spark, q=text.match_query(F.lit(asked))).q
    want = db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY 2, 1", (query,)).fetchall()
    rows = spark.createDataFrame([(i + 1, c, "cat" if i == 2 else "") for i, c in enumerate(CORPUS)], "chunk_id long, content string, heading_path string")
    got = R.bm25(R.indexed(rows, stem=True), R.phrases_of(asked, stem=True), 10).collect()
    assert [r.chunk_id for r in got] == [i for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_porter_is_that_of_fts5():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valency digitizer conformably radically differently vileness analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adoption communism activate angularity homologous effective bowdlerize probate rate cease controlling rolling archaeology knightly yes by eyeing".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", list(enumerate(words, 1)))
    want = dict(db.execute("SELECT doc, term FROM v").fetchall())
    assert {w: porter.stem(w) for w in words} == {w: want[i] for i, w in enumerate(words, 1)}


def test_long_queries_score_as_short_ones(spark):
    rows = spark.createDataFrame([(i, c, "") for i, c in enumerate(CORPUS)], "chunk_id long, content string, heading_path string")
    index = R.indexed(rows)
    for phrases in ([["cat"], ["the"], ["cat"]], [["mat", "cat"], ["the"], ["mat"]]):
        a, b = R.bm25(index, phrases, 9).collect(), R.bm25_long(index, phrases, 9).collect()
        assert [r.chunk_id for r in a] == [r.chunk_id for r in b] and [r.score for r in a] == pytest.approx([r.score for r in b])


@pytest.fixture(scope="module")
def index(spark):
    """Five documents on three topics; the last is an image."""
    rows = [(1, "a/rust.md", "rust is a systems language"), (2, "a/more.md", "rust language borrow checker"), (3, "b/cook.md", "salt and pepper"), (4, "b/pan.md", "pan and salt"), (5, "c/pic.png", "")]
    chunks = spark.createDataFrame([(i, p, 0, "", c, "image" if i == 5 else "text", None, None, None, None, False) for i, p, c in rows], "chunk_id long, path string, chunk_idx long, heading_path string, content string, media_type string, mime_type string, media_start long, media_end long, media_unit string, truncated boolean")
    v = {1: [1, 0], 2: [0.9, math.sqrt(1 - 0.81)], 3: [0, 1], 4: [0.1, math.sqrt(0.99)], 5: [0.65, math.sqrt(1 - 0.65**2)]}
    vecs = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in v.items()], "chunk_id long, embedding array<float>")
    files = spark.createDataFrame([(p,) for _, p, _ in rows] + [("empty.md",)], "path string")
    return S.Index(chunks, vecs, R.indexed(chunks.filter("media_type = 'text'")), files, 2)


def test_search(index):
    hits = S.search(index, " rust language ", [1.0, 0.0], 3).collect()
    assert [h.path for h in hits][:2] == ["a/rust.md", "a/more.md"]
    # The shorter document ranks first by text.
    assert hits[0].score_normalized == pytest.approx(0.55 + 0.45 * 11 / 12) and hits[0].title == "rust"
    assert all(a.score_rrf >= b.score_rrf for a, b in zip(hits, hits[1:], strict=False))


def test_search_refuses(index):
    with pytest.raises(BadRequest):
        S.search(index, "  ", [1.0, 0.0])
    with pytest.raises(DimMismatch):
        S.search(index, "x", [1.0])


def test_media_search_and_lane(index):
    only = S.search(index, "rust", [1.0, 0.0], media_only=True).collect()
    assert [h.path for h in only] == ["c/pic.png"] and only[0].snippet == "Image" and only[0].score_normalized == pytest.approx(1.0)
    lane = Display(lane=MediaLane(enabled=True, fraction=0.5))
    hits = S.search(index, "rust", [1.0, 0.0], 2, display=lane).collect()
    assert [h.path for h in hits] == ["a/rust.md", "c/pic.png"] and hits[1].score_normalized == pytest.approx(0.6, abs=1e-6)


def test_similar(index):
    assert [h.path for h in S.similar(index, "a/rust.md", 2).collect()][0] == "a/more.md"
    assert S.similar(index, "empty.md").collect() == []
    with pytest.raises(PathNotIndexed):
        S.similar(index, "nope.md")


def test_batch_rankings(spark, index):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query array<float>")
    got = R.knn_batch(index.vectors, q, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 1), (1, 2), (2, 3), (2, 4)]
    t = spark.createDataFrame([(1, "rust language"), (2, "salt")], "query_id long, text string")
    got = R.bm25_batch(index.terms, t, 5).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, 1), (1, 2), (2, 3), (2, 4)}
    alone = {r.chunk_id: r.score for r in R.bm25(index.terms, [["rust"], ["language"]], 5).collect()}
    assert {r.chunk_id: r.score for r in got if r.query_id == 1} == pytest.approx(alone)


def test_batch_asks_for_whole_texts(spark, tmp_path):
    """Chunks that hold the first words of a benchmark text, but not all of them, are no hits."""
    docs = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta"), (3, "gamma beta alpha"), (4, "epsilon delta gamma beta alpha again alpha"), (5, "zeta")]
    items = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma"), (3, "alpha beta gamma delta zeta"), (4, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.chunk_id): r.score for r in catalog.bm25_batch_text(spark, str(tmp_path)).collect()}
    mean = sum(len(t.split()) for _, t in docs) / len(docs)
    want = {}
    for q, asked in items:
        for i, t in docs:
            w = t.split()
            if asked and set(asked.split()) <= set(w):
                score = 0.0
                for x in set(asked.split()):
                    d = sum(x in u.split() for _, u in docs)
                    r = (len(docs) - d + 0.5) / (d + 0.5)
                    score -= (math.log(r) if r > 1 else 1e-6) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))
                want[q, i * 1000] = score
    assert set(want) == {(1, 1000), (1, 4000), (2, 1000), (2, 2000), (2, 3000), (2, 4000)} and got == pytest.approx(want, abs=1e-6)


def tables(spark, path, docs, items):
    """The tables that the text queries read; the one embedding belongs to no document of text."""
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(10**6, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def rows_of_sql(path, name, names):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        for n in names:
            c.sql(f"CREATE VIEW {n} AS FROM '{path}/{n}.parquet/*.parquet'")
        return c.sql(catalog.ORACLE_SQL[name]).fetchall()


@pytest.mark.parametrize(("name", "asked"), [("bm25_batch", "alpha"), ("bm25_batch_text", "alpha beta gamma delta")])
def test_batch_ties_rank_by_id(spark, tmp_path, name, asked):
    """Scores that are the same to nine decimals are a tie: the smaller id ranks first, though the other is a bit better."""
    words = asked.split()
    docs = [(i, " ".join(words * (480 // len(words)) + ["omega"] * n)) for i, n in ((1, 3), (2, 1), (3, 2), (4, 1))] + [(5, "omega")]
    tables(spark, str(tmp_path), docs, [(1, asked)])
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted((r[3], r[1]) for r in got) == [(1, 1000), (2, 2000), (3, 3000), (4, 4000)]
    assert sorted(got) == sorted(rows_of_sql(tmp_path, name, ("documents", "benchmark", "embeddings")))


def test_batch_sums_are_the_same_in_any_order(spark):
    """Copies have one score to the last bit, so that no rounding edge parts them, and it is the sum of their parts."""
    words = [f"w{i}" for i in range(60)]
    copy = [w for i, w in enumerate(words) for _ in range(i % 7 + 1)]
    rows = [(i, copy if i % 3 else [words[i % 60], "other"]) for i in range(600)]
    index = spark.createDataFrame([(i, t, [], len(t)) for i, t in rows], "chunk_id long, content_terms array<string>, heading_terms array<string>, n_terms int").repartition(7)
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, text string")
    got = sorted(R.bm25_batch(index, asked, 400, places=None).collect(), key=lambda r: r["rank"])
    assert [r.chunk_id for r in got] == [i for i, _ in rows if i % 3] and len({r.score for r in got}) == 1
    mean = sum(len(t) for _, t in rows) / len(rows)
    n_with = [400 + sum(t[0] == w and len(t) == 2 for _, t in rows) for w in words]
    parts = [max(1e-6, math.log((600 - d + 0.5) / (d + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(copy) / mean)) for d, tf in ((d, i % 7 + 1) for i, d in enumerate(n_with))]
    assert got[0].score == pytest.approx(-math.fsum(parts), rel=1e-12)


def test_equal_texts_rank_by_id_in_long_queries(spark):
    """Sums of many parts are the same for copies, however their rows are dealt out: the last bits order nothing."""
    words = [f"w{i}" for i in range(60)]
    copy = [w for i, w in enumerate(words) for _ in range(i % 7 + 1)]
    rows = [(i, copy if i % 3 else [words[i % 60], "other"]) for i in range(600)]
    made = spark.createDataFrame(rows, "chunk_id long, content_terms array<string>").repartition(16, F.xxhash64("chunk_id")).selectExpr("*", "CAST(array() AS array<string>) AS heading_terms", "CAST(size(content_terms) AS long) AS n_terms").persist()
    got = R.bm25_long(made, [[w] for w in words + words[:9]], None).collect()
    assert sorted(r.chunk_id for r in got) == [i for i in range(600) if i % 3] and len({r.score for r in got}) == 1
    best = R.bm25_long(made, [[w] for w in words + words[:9]], 30).collect()
    assert [r.chunk_id for r in best] == [i for i in range(600) if i % 3][:30]


def test_response_leaves_out_nulls(index):
    row = S.response(S.search(index, "salt", [0.0, 1.0], 1)).first()[0]
    assert "mime_type" not in row and "truncated" not in row and '"path"' in row


def test_error_envelopes():
    assert envelope(BadRequest("x"))[0] == 400 and envelope(PathNotIndexed("x"))[0] == 404
    assert envelope(RuntimeError("secret")) == (500, {"error": {"code": "internal", "message": "internal error"}})


def test_stemmed_ranking_with_headings(spark):
    """Stems in content and heading, by a plain reading of the formula."""
    from lodestone.functions.porter import stem

    rows = [(1, "running dogs run", "Dogs"), (2, "the runner ran", "cats and dogs"), (3, "a run of dogs, dogged", None), (4, "nothing", "run"), (5, None, "dog run")]
    got = {r.chunk_id: r.score for r in R.bm25(R.indexed(spark.createDataFrame(rows, "chunk_id long, content string, heading_path string"), stem=True), R.phrases_of("runs dog", True), 10).collect()}
    terms = {i: [stem(w) for x in (c, h) for w in re.findall("[a-z]+", (x or "").lower())] for i, c, h in rows}
    mean, want = sum(map(len, terms.values())) / len(terms), {}
    asked = [stem("runs"), stem("dog")]
    assert asked == ["run", "dog"]
    for i, t in terms.items():
        if all(a in t for a in asked):
            score = 0.0
            for a in asked:
                n = sum(a in x for x in terms.values())
                weight = max(1e-6, math.log((len(terms) - n + 0.5) / (n + 0.5)))
                score -= weight * t.count(a) * 2.2 / (t.count(a) + 1.2 * (0.25 + 0.75 * len(t) / mean))
            want[i] = score
    assert set(got) == set(want) == {1, 3, 5} and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_batch_of_odd_vectors(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0, 1.0]), (5, [0.0, 2.0]), (6, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [0.0, 0.0, 1.0])], "query_id long, query array<float>")
    got = [(r.query_id, r.chunk_id, None if r.distance is None else round(r.distance, 6)) for r in R.knn_batch(vecs, asked, 3).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 0.0), (7, 6, 0.0), (7, 5, 1.0), (8, 1, None), (8, 2, None), (8, 3, None), (9, 4, round(1 - 1 / 3**0.5, 6)), (9, 1, None), (9, 2, None)]
