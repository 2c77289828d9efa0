"""The store, media preparation, provider requests, the service and the watcher."""

import base64
import json
import os
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import service
from lodestone.config import MediaOptions
from lodestone.errors import AccessDenied, EmbedError, MediaError, ServerFailure
from lodestone.sources import embed, ingest, listing, media
from lodestone.sources.store import Store
from lodestone.streaming import feed, watch
from tests.test_ingest import scanned

MODEL = embed.lookup("fake", "m")


def picky(dim):
    """Fails on texts that hold a word.  A class of its own scope goes to the workers by value."""

    class Picky(embed.Fake):
        batch = 2

        def documents(self, inputs):
            if any(isinstance(x, str) and "poison" in x for x in inputs):
                raise EmbedError("poison\nhere")
            return embed.Fake.documents(self, inputs)

    return Picky(dim)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/index", buckets=4)
    s.open("fake", "m", 8)
    return s


def none(spark):
    return spark.createDataFrame([], "path string")


def contents(store):
    return {r.path: r.content for r in store.table("chunks").collect()}


def test_a_writer_that_stops_midway_leaves_the_old_version(spark, store, tmp_path):
    store.apply(scanned(spark, {"a.md": "alpha"}), none(spark), embed.Fake(8), MODEL)
    v, folder = store.version, tmp_path / "index"
    (folder / "data" / f"{0:020d}-left").mkdir()  # tables written, manifest not
    assert store.version == v and contents(store) == {"a.md": "alpha"}
    (folder / "versions" / f"{v + 1:012d}.json").write_text('{"version": 3, "ta')  # manifest cut off
    assert store.version == v and contents(store) == {"a.md": "alpha"}
    store.apply(scanned(spark, {"b.md": "beta"}), none(spark), embed.Fake(8), MODEL)
    assert store.version == v + 2 and contents(store) == {"a.md": "alpha", "b.md": "beta"}
    assert store.vacuum(older_than_s=1) >= 1 and contents(store) == {"a.md": "alpha", "b.md": "beta"}


def test_of_two_writers_from_one_version_one_fails(spark, store):
    now = store.manifest()
    store._publish(now)
    with pytest.raises(Exception, match="exist"):
        store._publish(now)


def test_only_touched_buckets_are_written_and_ids_stay(spark, store):
    files = {f"{i}.md": f"text {i}" for i in range(12)}
    store.apply(scanned(spark, files), none(spark), embed.Fake(8), MODEL)
    before, ids = store.manifest()["tables"], {r.path: r.chunk_id for r in store.table("chunks").collect()}
    store.apply(scanned(spark, {"3.md": "other"}), none(spark), embed.Fake(8), MODEL)
    after = store.manifest()["tables"]
    assert sum(before["chunks"][b] != after["chunks"][b] for b in after["chunks"]) == 1
    assert {r.path: r.chunk_id for r in store.table("chunks").collect()} == ids
    assert contents(store) == files | {"3.md": "other"} and store.table("vectors").count() == 12
    v, stamp = store.version, store.last_reindex_ms
    assert store.apply(scanned(spark, {"3.md": "other"}), none(spark), embed.Fake(8), MODEL) == v == store.version
    assert store.last_reindex_ms == stamp > 0 and store.file_state("3.md")[1] == 1 and store.file_state("no") is None
    store.set_meta("note", "x")
    assert store.get_meta("note") == "x" and store.get_meta("none") is None and contents(store)["3.md"] == "other"


def test_one_bad_file_holds_nothing_else_up(spark, store):
    store.apply(scanned(spark, {"a.md": "old"}), none(spark), picky(8), MODEL)
    rows = scanned(spark, {"a.md": "poison", "b.md": "fine", "c.md": "good"}).withColumn("error", F.lit(None).cast("string"))
    broken = spark.createDataFrame([("d.md", "text", 0, None, None, "OSError: gone bad")], rows.schema)
    store.apply(rows.union(broken), none(spark), picky(8), MODEL)
    assert contents(store) == {"a.md": "old", "b.md": "fine", "c.md": "good"}
    assert {r.path: r.error for r in store.table("errors").collect()} == {"a.md": "poison here", "d.md": "OSError: gone bad"}
    store.apply(scanned(spark, {"a.md": "new"}), spark.createDataFrame([("d.md",)], "path string"), picky(8), MODEL)
    assert contents(store)["a.md"] == "new" and store.table("errors").count() == 0


def test_schema_before_media_gets_its_columns(spark, store):
    store.apply(scanned(spark, {"a.md": "alpha"}), none(spark), embed.Fake(8), MODEL)
    old = store.table("chunks").drop("media_type", "mime_type", "media_start", "media_end", "media_unit", "truncated")
    now, work = store.manifest(), store._work()
    old.write.parquet(f"{store.folder}/{work}/chunks")
    store._publish(now | {"tables": now["tables"] | {"chunks": {"0": f"{work}/chunks"}}, "meta": now["meta"] | {"schema_version": "2"}})
    assert store.open("fake", "m", 8) == "match" and store.get_meta("schema_version") == "3"
    r = store.table("chunks").first()
    assert (r.media_type, r.truncated, r.media_start, r.content) == ("text", False, None, "alpha") and store.table("vectors").count() == 1


# Media


def filtered_png(image, how):
    """A PNG whose rows all have one filter."""
    h, w, _ = image.shape
    rows = b""
    for y in range(h):
        rows += bytes([how])
        for x in range(w):
            for c in range(4):
                s, a, b, d = (int(image[y, x, c]), int(image[y, x - 1, c]) if x else 0, int(image[y - 1, x, c]) if y else 0, int(image[y - 1, x - 1, c]) if x and y else 0)
                p = a + b - d
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
                rows += bytes([(s - (0, a, b, (a + b) // 2, paeth)[how]) & 255])
    part = lambda n, body: struct.pack(">I", len(body)) + n + body + struct.pack(">I", zlib.crc32(n + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def a_gif(frames):
    """2 x 2 pixels of four colours, each code as a literal after a clear code."""
    codes, bits, out = [4, 1, 4, 2, 4, 3, 4, 0, 5], 0, 0
    for c in codes:
        out |= c << bits
        bits += 3
    packed = out.to_bytes((bits + 7) // 8, "little")
    frame = b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02" + bytes([len(packed)]) + packed + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes(range(12)) + frame * frames + b"\x3b"


@pytest.mark.parametrize("how", range(5))
def test_png_of_each_filter(how):
    image = np.random.default_rng(how).integers(0, 256, (5, 4, 4)).astype(np.uint8)
    assert (media.unpng(filtered_png(image, how)) == image).all() and (media.unpng(media.png(image)) == image).all()


def test_images():
    image, moves = media.gif(a_gif(2))
    assert moves and not media.gif(a_gif(1))[1] and image[..., :3].reshape(-1, 3).tolist() == [[3, 4, 5], [6, 7, 8], [9, 10, 11], [0, 1, 2]]
    mime, data, moves = media.prepared_image(a_gif(2), media.Decoders())
    assert (mime, moves) == ("image/png", True) and (media.unpng(data) == image).all()
    flat = np.full((8, 6, 4), 77, dtype=np.uint8)
    mime, data, _ = media.prepared_image(media.png(flat), media.Decoders(), most=12)
    assert media.unpng(data).shape == (4, 3, 4) and (media.unpng(data) == 77).all()
    same = media.png(flat)
    assert media.prepared_image(same, media.Decoders()) == ("image/png", same, False)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 9
    assert media.jpeg_size(jpeg) == (40, 30) and media.prepared_image(jpeg, media.Decoders())[1] == jpeg
    for bad in (b"text", b"RIFF0000WEBPVP8X" + b"\x02" * 20, b"\xff\xd8\xff"):
        with pytest.raises(MediaError):
            media.prepared_image(bad, media.Decoders())


def a_pdf(pages):
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /MediaBox [0 0 9 9] /Kids [%s] >>" % (pages, b" ".join(b"%d 0 R" % (i + 3) for i in range(pages)))]
    bodies += [b"<< /Type /Page /Parent 2 0 R /N %d >>" % i for i in range(pages)]
    out = b"%PDF-1.4\n"
    for i, b in enumerate(bodies, 1):
        out += b"%d 0 obj\n%s\nendobj\n" % (i, b)
    return out + b"xref\n0 1\ntrailer\n<< /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, len(out))


def test_pdfs():
    data, options = a_pdf(8), MediaOptions(enabled=True, pdf_pages_per_chunk=3)
    parts = media.prepared_pdf(data, "native", options, media.Decoders())
    assert [(s, e) for s, e, _ in parts] == [(0, 3), (3, 6), (6, 8)]
    for s, e, [(mime, part)] in parts:
        objects, root, pages = media.pdf_pages(part)
        assert mime == "application/pdf" and [int(objects[p].split(b"/N ")[1].split()[0]) for p in pages] == list(range(s, e)) and all(b"/MediaBox [0 0 9 9]" in objects[p] for p in pages)
        at = int(part.split(b"startxref")[-1].split()[0])
        assert part[at : at + 4] == b"xref" and b"/Prev" in part
    one = a_pdf(2)
    assert media.prepared_pdf(one, "native", options, media.Decoders()) == [(0, 2, [("application/pdf", one)])]
    shown = media.prepared_pdf(one, "raster", options, media.Decoders(page=lambda d, p, dpi: b"%d %d" % (p, dpi)))
    assert shown == [(0, 2, [("image/png", b"0 150"), ("image/png", b"1 150")])]
    for mode, bad in (("none", one), ("raster", one), ("native", b"%PDF-1.4 nothing"), ("native", a_pdf(0))):
        with pytest.raises(MediaError):
            media.prepared_pdf(bad, mode, options, media.Decoders())


def test_media_rows_in_the_index(spark, store, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.gif").write_bytes(a_gif(2))
    (vault / "b.pdf").write_bytes(a_pdf(8))
    (vault / "c.png").write_bytes(b"no image")
    (vault / "d.md").write_text("# words")
    options, native = MediaOptions(enabled=True, pdf_pages_per_chunk=3), embed.lookup("gemini", "gemini-embedding-2")
    feed.reconcile(store, str(vault), embed.Fake(8), native, options)
    rows = {(r.path, r.chunk_idx): r for r in store.table("chunks").collect()}
    assert set(rows) == {("a.gif", 0), ("b.pdf", 0), ("b.pdf", 1), ("b.pdf", 2), ("d.md", 0)} and store.table("vectors").count() == 5
    gif, pdf = rows["a.gif", 0], rows["b.pdf", 2]
    assert (gif.media_type, gif.mime_type, gif.truncated, gif.media_unit) == ("image", "image/png", True, None)
    assert (pdf.media_type, pdf.media_start, pdf.media_end, pdf.media_unit, pdf.content) == ("pdf", 6, 8, "page", "")
    assert [r.path for r in store.table("errors").collect()] == ["c.png"]
    assert {r.task_type for r in store.table("cache").collect()} == {"document"}
    (vault / "b.pdf").unlink()
    feed.reconcile(store, str(vault), embed.Fake(8), native, options)
    assert {r.path for r in store.table("files").collect()} == {"a.gif", "d.md"}


# Providers


def test_requests_of_the_providers():
    parts = [("image/png", b"\1\2\3")]
    old, new = embed.lookup("gemini", "gemini-embedding-001"), embed.lookup("gemini", "")
    r = embed.gemini_request(old, 768, ["x"], False, "k", "http://g")
    assert r.url == "http://g/v1beta/models/gemini-embedding-001:embedContent" and r.headers == {"x-goog-api-key": "k"}
    assert r.body == {"content": {"parts": [{"text": "x"}]}, "taskType": "RETRIEVAL_DOCUMENT", "outputDimensionality": 768} and r.found({"embedding": {"values": [1]}}) == [[1]]
    assert embed.gemini_request(old, 768, ["x"], True).body["taskType"] == "RETRIEVAL_QUERY"
    r = embed.gemini_request(new, 768, ["x", parts], False, "k", "http://g")
    assert r.url.endswith("gemini-embedding-2:batchEmbedContents") and r.found({"embeddings": [{"values": [1]}, {"values": [2]}]}) == [[1], [2]]
    assert r.body["requests"] == [
        {"model": "models/gemini-embedding-2", "content": {"parts": [{"text": "title: none | text: x"}]}, "outputDimensionality": 768},
        {"model": "models/gemini-embedding-2", "content": {"parts": [{"inlineData": {"mimeType": "image/png", "data": "AQID"}}]}, "outputDimensionality": 768},
    ]
    assert embed.gemini_request(new, 768, ["x"], True).body["content"]["parts"][0]["text"] == "task: search result | query: x"
    r = embed.voyage_request(embed.lookup("voyage", ""), 256, ["a", "b"], False, "k", "http://v")
    assert (r.url, r.headers, r.body) == ("http://v/v1/embeddings", {"Authorization": "Bearer k"}, {"model": "voyage-4", "input_type": "document", "truncation": False, "output_dimension": 256, "input": ["a", "b"]})
    r = embed.voyage_request(embed.lookup("voyage", "voyage-multimodal-3.5"), 256, ["a", parts], True)
    assert r.body["inputs"] == [{"content": [{"type": "text", "text": "a"}]}, {"content": [{"type": "image_base64", "image_base64": "data:image/png;base64," + base64.b64encode(b"\1\2\3").decode()}]}] and r.body["input_type"] == "query"


def test_batches_and_what_is_turned_down():
    sizes = []

    def post(request):
        n = len(request.body.get("requests", request.body.get("input", request.body.get("inputs", [0]))))
        sizes.append(n)
        return 200, {"data": [{"index": i, "embedding": [0.0] * 2} for i in range(n)], "embeddings": [{"values": [0.0] * 2}] * n, "embedding": {"values": [0.0] * 2}}, None

    for name, most in (("voyage-4", 128), ("voyage-multimodal-3.5", 4), ("gemini-embedding-2", 16), ("gemini-embedding-001", 1)):
        sizes.clear()
        model = embed.lookup("voyage" if name.startswith("voyage") else "gemini", name)
        assert len(embed.Remote(model, 2, post).documents(["x"] * (most + 1))) == most + 1 and sizes == ([most, 1] if most > 1 else [1, 1])
    with pytest.raises(EmbedError, match="takes no media"):
        embed.Remote(embed.lookup("voyage", "voyage-4"), 2, post).documents([[("image/png", b"")]])
    with pytest.raises(EmbedError, match=r"doc\[1\]: no"):
        embed.Remote(embed.lookup("gemini", "gemini-embedding-001"), 2, lambda r: post(r) if r.body["content"]["parts"][0]["text"] == "a" else (400, {"error": {"message": "no"}}, None)).documents(["a", "b"])
    with pytest.raises(EmbedError, match="2 inputs, 1 embeddings"):
        embed.Remote(embed.lookup("voyage", "voyage-4"), 2, lambda r: (200, {"data": [{"embedding": [1, 2]}]}, None)).documents(["a", "b"])
    with pytest.raises(EmbedError, match="VOYAGE_API_KEY"):
        embed.create("voyage", "", 0, {})
    assert embed.create("", "", 0, {})[1].dim == 128 and embed.create("", "", 768, {"GEMINI_API_KEY": "k"}, post)[1].batch == 16


# Service


def test_service_and_client(spark, store):
    store.apply(scanned(spark, {"a.md": "# Title\nalpha beta", "b.md": "beta gamma", "c.md": "delta"}), none(spark), embed.Fake(8), MODEL)
    s = service.Service(store, embed.Fake(8), "m", "secret", stem=False)
    server = s.serve()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        client, stranger = service.Client(at, "secret"), service.Client(at, "guess")
        assert stranger.health() == {"ok": True, "authenticated": False}
        health = client.health()
        assert (health["indexed_chunks"], health["dim"], health["embedding_model"]) == (3, 8, "m") and health["last_reindex_ms"] > 0
        hits = client.search(" beta ", 2)
        assert [set(h) >= {"path", "snippet", "score_normalized", "chunk_id"} and "truncated" not in h for h in hits] == [True, True] and {h["path"] for h in hits} == {"a.md", "b.md"}
        assert "a.md" not in {h["path"] for h in client.similar("a.md")}
        for call, error, text in ((lambda: stranger.search("x"), AccessDenied, "bearer"), (lambda: client.search("  "), ServerFailure, "400"), (lambda: client.similar("zz"), ServerFailure, "404"), (lambda: client.search("x", media_types=["pdf"]), ServerFailure, "media_only")):
            with pytest.raises(error, match=text):
                call()
    finally:
        server.shutdown()
    assert s.answer("POST", "/search", "Bearer secret", b"[1]") == (400, {"error": "the body must be an object", "code": "bad_request"})
    assert s.answer("GET", "/x", None, b"")[0] == 404 and s.answer("POST", "/search", None, b"{}")[0] == 401
    s.index = lambda: 1 / 0
    assert s.answer("POST", "/search", "Bearer secret", b'{"query": "x"}') == (500, {"error": "internal error", "code": "internal"})


# Watching


def test_paths_inside(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.md").write_text("x")
    (tmp_path / "out.md").write_text("y")
    os.symlink(tmp_path / "out.md", tmp_path / "in/link.md")
    root = str(tmp_path / "in")
    assert listing.relative_inside(root, f"{root}/sub/a.md") == "sub/a.md" == listing.relative_inside(root, f"{root}/sub/../sub/a.md")
    assert [listing.relative_inside(root, f"{root}/{x}") for x in ("link.md", "../out.md", "none.md")] == [None] * 3


def test_relevant_changes(spark):
    rows = [("a.md", "modify", True), ("dir.md", "create", False), ("gone.png", "remove", False), ("b.rtf", "create", True), (".git/x.md", "remove", False), ("c.md", "access", True)]
    events = spark.createDataFrame(rows, "path string, kind string, is_file boolean")
    got = {r.path for r in feed.relevant(events, options=MediaOptions(enabled=True)).collect()}
    assert got == {"a.md", "gone.png"} and feed.relevant(events).count() == 5


def test_watcher_feeds_the_index(spark, store, tmp_path):
    vault, log = tmp_path / "vault", tmp_path / "log"
    vault.mkdir()
    (vault / "a.md").write_text("alpha")
    watcher = watch.Watcher(str(vault), str(log))
    assert watcher.poll() == 0
    q = feed.serve(watch.source(spark, str(log), 1), store, str(vault), embed.Fake(8), MODEL, str(tmp_path / "cp"), idle="1 second")
    try:
        assert contents(store) == {"a.md": "alpha"}  # brought in line before the feed began
        (vault / "b.md").write_text("beta")
        (vault / "a.md").unlink()
        assert watcher.poll() == 2
        with open(log / "9.json", "w") as f:  # a later event moves the watermark
            f.write(json.dumps({"path": "z.md", "kind": "remove", "ts": "2099-01-01T00:00:00Z", "is_file": False}) + "\n")
        q.processAllAvailable()
        assert contents(store) == {"b.md": "beta"}
    finally:
        assert feed.shut_down(q)
    w = watch.Watcher(str(vault), str(log), 0.05).start()
    assert w.stop()


def test_dirty_union_and_gauge(spark):
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert sorted(r.path for r in feed.dirty_union(df("a", "b"), df("c"), df("a", "d", "d")).collect()) == ["a", "b", "c", "d"]
    events = spark.createDataFrame([("a", 5), ("b", 9)], "path string, s long").select("path", F.timestamp_seconds("s").alias("ts"))
    assert feed.last_change(events).first()[0] == 9000 and feed.last_change(events.limit(0)).first()[0] is None


def test_last_change_rounds(spark):
    """Parts of a millisecond are rounded as the SQL rounds them, before 1970 too."""
    micros = [0, 1499, 1500, 1999, 1706659165261499, 1706659165261500, 1706659165261702, -1499, -1500, -1501, -315619199998500, None]
    with duckdb.connect() as c:
        want = [c.execute("SELECT epoch_ms(make_timestamp(CAST(? AS BIGINT)))", [x]).fetchone()[0] for x in micros]
    one = lambda x: spark.createDataFrame([("a", x)], "path string, us long").select("path", F.timestamp_micros("us").alias("ts"))
    assert [feed.last_change(one(x)).first()[0] for x in micros] == want and want[5] == 1706659165262


def test_scan_keeps_going(spark, tmp_path):
    (tmp_path / "a.md").write_text("alpha")
    found = spark.createDataFrame([("a.md", "text"), ("gone.md", "text"), ("", "text")], "path string, media_type string")
    (tmp_path / "d.md").mkdir()
    rows = {r.path: r for r in listing.scan_paths(found.union(spark.createDataFrame([("d.md", "text")], found.schema)), str(tmp_path)).collect()}
    assert rows["a.md"].error is None and "IsADirectory" in rows["d.md"].error and "gone.md" not in rows
    assert ingest.dirty(spark.createDataFrame([("a", "1")], "path string, content_hash string"), spark.createDataFrame([], "path string, content_hash string")).count() == 1
