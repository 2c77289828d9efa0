import hashlib
import os
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.config import MediaOptions, load
from lodestone.errors import BadRequest, EmbedError, FingerprintMismatch, Unauthorized
from lodestone.operators.chunking import chunked
from lodestone.sources import embed, ingest, listing, policy
from lodestone.sources.store import Store
from lodestone.streaming import feed


def chunks(spark, text, size=500, overlap=50):
    return chunked(spark.createDataFrame([(1, text)], "id long, text string"), "text", size, overlap).orderBy("chunk_idx").collect()


def test_heading_paths(spark):
    got = chunks(spark, "# A\nintro\n## B\nmid\n### C\nleaf\n## D\nsecond")
    assert [c.heading_path for c in got] == ["A", "A > B", "A > B > C", "A > D"]
    assert [c.chunk_idx for c in got] == [0, 1, 2, 3] and got[0].content == "# A\nintro"


def test_fences_hide_headings(spark):
    got = chunks(spark, "# A\n```\n## not\n```\n## B\nx")
    assert [c.heading for c in got] == ["A", "B"] and "## not" in got[0].content


def test_preamble_deep_headings_and_blanks(spark):
    got = chunks(spark, "before\n\n#### deep\ntext\n# A ##\r\n\n")
    assert [(c.heading, c.content) for c in got] == [("", "before\n\n#### deep\ntext"), ("A", "# A ##")]
    assert chunks(spark, " \n\n ") == [] and chunks(spark, "") == [] and chunks(spark, None) == []


def test_windows_overlap_under_the_heading(spark):
    words = [f"w{i}" for i in range(250)]
    got = chunks(spark, "# T\n" + " ".join(words), 100, 20)
    assert len(got) == 3 and all(c.content.startswith("# T\n") for c in got)
    bodies = [c.content.split("\n")[1].split() for c in got]
    assert [b[0] for b in bodies] == ["w0", "w80", "w160"] and bodies[-1][-1] == "w249"
    assert got[0].content_hash == hashlib.sha256(got[0].content.encode()).hexdigest() and got[0].tokens == 102


@pytest.mark.parametrize("n", [1, 99, 100, 101, 180, 181, 399])
def test_windows_cover_all_words(spark, n):
    got = chunks(spark, " ".join(str(i) for i in range(n)), 100, 20)
    seen = [int(w) for c in got for w in c.content.split()]
    assert set(seen) == set(range(n)) and len(got) == (1 if n <= 100 else -(-(n - 100) // 80) + 1)


def test_scan(spark, tmp_path):
    for name in ("a.md", "b.md", "notes/c.md", "_x.md", "x.rtf", ".dot.md", ".git/h.md", "node_modules/n.md", "p.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "b.md" else name)
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    got = listing.scan(spark, str(tmp_path)).collect()
    assert [r.path for r in got] == ["_x.md", "a.md", "b.md", "notes/c.md"]
    assert got[2].content == b"" and got[1].content_hash == hashlib.sha256(b"a.md").hexdigest()
    media = listing.scan(spark, str(tmp_path), MediaOptions(enabled=True)).filter("media_type = 'image'").first()
    assert media.content_hash == hashlib.sha256(b"p.png\0media-v1|max_file_mb=20|pdf_pages_per_chunk=6|pdf_dpi=150").hexdigest()


def test_globs(spark):
    paths = spark.createDataFrame([("a/x.png",), ("a/b/y.png",), ("z.png",), ("d.md",)], "path string")
    kind = lambda **o: {r[0] for r in paths.filter(policy.classified(F.col("path"), MediaOptions(enabled=True, **o)).isNotNull()).collect()}
    assert kind() == {"a/x.png", "a/b/y.png", "z.png", "d.md"}
    assert kind(include=("a/*",)) == {"a/x.png", "a/b/y.png", "d.md"}
    assert kind(exclude=("**/y.png",), include=("**/*.{png,gif}",)) == {"a/x.png", "z.png", "d.md"}
    assert kind(exclude_types=("IMAGE",)) == {"d.md"}
    with pytest.raises(ValueError, match="include"):
        policy.glob_pattern("a[", "include")


def test_diff(spark):
    scan = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    files = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content_hash string")
    assert dict(ingest.diff(scan, files).collect()) == {"a": "unchanged", "b": "changed", "c": "new", "d": "removed"}
    assert tuple(ingest.summary(scan, files).first()) == (3, 2, 1)


def test_fake_vectors():
    v = embed.Fake(20).query("x")
    h = [hashlib.sha256(b"query\0x" + i.to_bytes(8, "little")).digest() for i in (0, 8, 16)]
    raw = np.array([int.from_bytes(h[i // 8][2 * (i % 8) : 2 * (i % 8) + 2], "big", signed=True) for i in range(20)], dtype=np.float32) / 32768
    assert np.allclose(v, raw / np.linalg.norm(raw), atol=1e-6) and v.dtype == np.float32
    assert not np.allclose(v, embed.Fake(20).documents(["x"])[0])


def test_vector_bytes():
    assert embed.decode_f32(embed.encode_f32([1.5, -2.0])).tolist() == [1.5, -2.0]
    with pytest.raises(ValueError):
        embed.decode_f32(b"abc")


def test_registry():
    assert embed.lookup("gemini", "").name == "gemini-embedding-2" and embed.lookup("fake", "any", 7).dims == ()
    with pytest.raises(EmbedError):
        embed.lookup("voyage", "voyage-4", 7)
    with pytest.raises(EmbedError):
        embed.lookup("voyage", "nope")
    assert embed.provider_of("", {"VOYAGE_API_KEY": "k"}) == "voyage" and embed.provider_of("", {}) == "fake"


def test_remote_tries_again():
    calls, waits = [], []

    def post(payload):
        calls.append(payload)
        if len(calls) < 3:
            return 429, {"error": "slow"}, 100.0 if len(calls) == 1 else None
        return 200, {"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}, None

    e = embed.Remote(embed.lookup("voyage", "voyage-4"), 2, post, waits.append)
    assert [v.tolist() for v in e.documents(["a", "b"])] == [[1, 2], [3, 4]] and waits == [60.0, 2.0]
    with pytest.raises(EmbedError):
        embed.Remote(embed.lookup("voyage", "voyage-4"), 2, lambda p: (400, {"error": "bad"}, None), waits.append).query("x")
    assert embed.told("a\nb" + "c" * 300) == ("a b" + "c" * 300)[:200] + "…"


def scanned(spark, files):
    rows = [(p, "text", 1, t, hashlib.sha256(t.encode()).hexdigest()) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, media_type string, mtime_ns long, content string, content_hash string")


def test_store_replaces_and_removes(spark, tmp_path):
    store, model, e = Store(spark, f"file://{tmp_path}/index"), embed.lookup("fake", "m"), embed.Fake(8)
    assert store.open("fake", "m", 8) == "fresh" and store.open("fake", "m", 8) == "match"
    none = spark.createDataFrame([], "path string")
    store.apply(scanned(spark, {"a.md": "# A\nalpha", "b.md": "beta", "e.md": ""}), none, e, model)
    assert {r.path for r in store.table("files").collect()} == {"a.md", "b.md", "e.md"}
    ids = [(r.path, r.chunk_id) for r in store.table("chunks").orderBy("chunk_id").collect()]
    assert [p for p, _ in ids] == ["a.md", "b.md"] and store.table("vectors").count() == 2
    v = store.version
    store.apply(scanned(spark, {"a.md": "gamma", "b.md": "beta"}), spark.createDataFrame([("e.md",)], "path string"), e, model)
    assert store.version == v + 1
    assert {r.content for r in store.table("chunks").collect()} == {"gamma", "beta"}
    assert {r.path for r in store.table("files").collect()} == {"a.md", "b.md"} and store.table("cache").count() == 3
    with pytest.raises(FingerprintMismatch):
        store.open("fake", "other", 8)
    assert store.open("fake", "other", 8, reembed=True) == "rebuilt" and store.table("chunks").count() == 0


def test_path_migration(spark, tmp_path):
    store, model, e = Store(spark, f"file://{tmp_path}/index"), embed.lookup("fake", "m"), embed.Fake(8)
    store.open("fake", "m", 8)
    none = spark.createDataFrame([], "path string")
    store.apply(scanned(spark, {"/v/a.md": "x", "/other/b.md": "y"}), none, e, model)
    assert store.migrate_paths("/v") == ("refused", 2, 0)
    store.apply(scanned(spark, {}), spark.createDataFrame([("/other/b.md",)], "path string"), e, model)
    assert store.migrate_paths("/v") == ("migrated", 1, 1)
    assert [r.path for r in store.table("chunks").collect()] == ["a.md"]
    assert store.migrate_paths("/v") == ("current", 0, 0)


def test_change_feed_stream(spark, tmp_path):
    source, out = tmp_path / "events", tmp_path / "index"
    schema = "path string, kind string, ts timestamp"
    (tmp_path / "vault").mkdir()
    (tmp_path / "vault/a.md").write_text("alpha")
    store, e = Store(spark, f"file://{out}"), embed.Fake(8)
    store.open("fake", "m", 8)

    def read(paths):
        rows = listing.scan(spark, str(tmp_path / "vault")).join(paths, "path", "left_semi")
        return rows.withColumn("content", listing.text_of())

    events = spark.createDataFrame([("a.md", "create", 0), ("a.md", "modify", 2), ("gone.md", "remove", 1), ("a.md", "access", 3), ("z.md", "create", 100)], "path string, kind string, s long")
    events.select("path", "kind", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = feed.maintain(stream, store, read, e, embed.lookup("fake", "m"), str(tmp_path / "checkpoint"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.path for r in store.table("files").collect()] == ["a.md"]


def test_bursts(spark):
    rows = [("a", "modify", 0), ("a", "modify", 4), ("a", "remove", 9), ("a", "modify", 20), ("b", "create", 1)]
    events = spark.createDataFrame(rows, "path string, kind string, s long").select("path", "kind", F.timestamp_seconds("s").alias("ts"))
    got = feed.debounced(events).orderBy("path", "start").collect()
    assert [(r.path, r.n_events, r.kind) for r in got] == [("a", 3, "remove"), ("a", 1, "modify"), ("b", 1, "create")]


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('dim = 64\n[media]\nenabled = true\nexclude = ["a/*"]\n[display.lane]\nfraction = 0.5\n')
    s = load({"debounce_ms": 10}, {"LODESTONE_DIM": "32", "LODESTONE_DISPLAY_K": "5"}, str(f))
    assert (s.dim, s.debounce_ms, s.display.k, s.media.exclude, s.display.lane.fraction) == (32, 10, 5.0, ("a/*",), 0.5)
    f.write_text("nope = 1\ndebounce_ms = -1\n")
    with pytest.raises(BadRequest, match="unknown key.*; "):
        load({}, {}, str(f))


def test_cli():
    with pytest.raises(BadRequest):
        cli.arguments(["x", "--limit", "0"])
    cli.authorised("Bearer t", "t")
    with pytest.raises(Unauthorized):
        cli.authorised("Bearer x", "t")
    assert cli.main([]) == 1


def test_only_the_entry_knows_the_llm_subpackage():
    found = subprocess.run(["grep", "-rlE", r"(from|import) .*\bllm\b", "lodestone", "--include=*.py"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__))).stdout.split()
    assert all(f.startswith("lodestone/llm/") for f in found)
