"""The data source of stored objects, in batch, as a stream and over HTTP."""

import functools
import http.server
import threading

from gradeloom.sources.objects import ObjectSource, mime_of


def put(folder, key, data):
    path = folder / key
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_objects_of_a_folder(spark, tmp_path):
    spark.dataSource.register(ObjectSource)
    want = {f"{d}/{i:02}.txt": b"x" * i for d in ("a", "a-b", "a.c", "b/deep") for i in range(7)} | {"a/0.pdf": b"%PDF-1", "z": b"\x89PNG\r\n\x1a\n", "a!": b"", "b/table.xlsx": b"PK\x03\x04"}
    for key, data in want.items():
        put(tmp_path, key, data)
    for size in ("1", "3", "1000"):
        df = spark.read.format("objects").option("path", str(tmp_path)).option("rangesize", size).load()
        assert {r.storage_key: bytes(r.content) for r in df.collect()} == want and df.count() == len(want)
        assert df.rdd.getNumPartitions() == -(-len(want) // int(size))
    kinds = {r.storage_key: (r.mime, r.bytes, r.content) for r in spark.read.format("objects").options(path=str(tmp_path), content="false").load().collect()}
    assert kinds["a/0.pdf"] == ("application/pdf", 6, None) and kinds["z"][0] == "image/png" and kinds["b/table.xlsx"][0].endswith("sheet") and kinds["a!"] == ("application/octet-stream", 0, None)
    only = spark.read.format("objects").options(path=str(tmp_path), prefix="a/", rangesize="2").load()
    assert sorted(r.storage_key for r in only.collect()) == sorted(k for k in want if k.startswith("a/"))
    (tmp_path / "none").mkdir()
    assert spark.read.format("objects").option("path", str(tmp_path / "none")).load().count() == 0
    assert mime_of("x.bin", b"", "text/html; charset=x") == "text/html" and mime_of("x", b"RIFF....WEBP") == "image/webp"


def test_objects_as_a_stream(spark, tmp_path):
    spark.dataSource.register(ObjectSource)
    folder, got = tmp_path / "in", []
    folder.mkdir()

    def run():
        q = spark.readStream.format("objects").options(path=str(folder), rangesize="2").load().writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, i: got.extend(r.storage_key for r in df.collect())).trigger(once=True).start()
        q.awaitTermination(120)

    for day in ("2024-01", "2024-02"):
        for i in range(5):
            put(folder, f"{day}/{i}", b"x")
        run()
    run()
    assert sorted(got) == [f"{day}/{i}" for day in ("2024-01", "2024-02") for i in range(5)]


def test_objects_over_http(spark, tmp_path):
    spark.dataSource.register(ObjectSource)
    put(tmp_path, "list.txt", b"a.png\n\nb.json\na.png\n")
    put(tmp_path, "a.png", b"\x89PNG\r\n\x1a\n")
    put(tmp_path, "b.json", b"{}")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.read.format("objects").options(path=f"http://127.0.0.1:{server.server_port}/list.txt", store="gradeloom.sources.objects:HttpStore", rangesize="1").load()
        assert sorted((r.storage_key, r.mime, r.bytes) for r in df.collect()) == [("a.png", "image/png", 8), ("b.json", "application/json", 2)]
    finally:
        server.shutdown()
