import io
import zipfile

from pyspark.sql import functions as F

from folioscope.sources import files
from folioscope.streaming import reindex


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        for x in "abc":
            z.writestr(f"o/{x}.xhtml", f"<html><nav>n</nav><p>text {x}</p></html>")
    return out.getvalue()


def test_folder_to_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT").write_bytes("你好，世界".encode("gb18030"))
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "~$lock.txt").write_text("x")
    (tmp_path / "skip.md").write_text("x")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.parse_files(files.scan_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"b.TXT", "a.epub", "bad.epub"}
    assert got["b.TXT"]["text"] == "你好，世界" and got["b.TXT"]["title"] == "b"
    assert (got["a.epub"]["title"], got["a.epub"]["text"]) == ("Book", "text a\n\ntext b\n\ntext c")
    assert got["bad.epub"]["text"] is None and got["bad.epub"]["error"]


def test_golden_lines(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('# note\n\n{"question": "q1", "relevant_snippets": ["a", "b"], "reference": "r"}\n{"question": "q2", "must_contain": "c", "ground_truth": "g"}\n{"question": " "}\n')
    got = {r["text"]: (r["snippets"], r["reference"]) for r in files.read_golden(spark, str(p)).collect()}
    assert got == {"q1": (["a", "b"], "r"), "q2": (["c"], "g")}


def test_watch_sees_each_file_once(spark, tmp_path):
    root, seen = tmp_path / "in", []
    root.mkdir()
    for i in range(2):
        (root / f"{i}.txt").write_text(str(i))
        q = reindex.watch(spark, str(root), str(tmp_path / "cp"), lambda d, n: seen.append(sorted(r["t"] for r in d.select(F.decode("content", "utf-8").alias("t")).collect())))
        q.awaitTermination(60)
    assert seen == [["0"], ["1"]]
