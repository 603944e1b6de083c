"""File sources and sinks on small folders."""

import os

from scriptorium.sources import files


def test_files_by_extension_age_and_size(spark, tmp_path):
    for i, n in enumerate(["a.txt", "sub/b.TXT", "c.pdf", "d.exe"]):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"text {i}\nä")
        os.utime(p, (1000 + i, 1000 + i))
    found = files.files(spark, [str(tmp_path)], ["txt", "pdf"])
    assert sorted(r.name for r in found.collect()) == ["a.txt", "b.TXT", "c.pdf"]
    assert [r.name for r in files.newest(found, 2).collect()] == ["c.pdf", "b.TXT"]
    assert files.files(spark, [str(tmp_path)], None, most=3).count() == 0
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.texts(spark, [str(tmp_path)]).collect()}
    assert got == {"a.txt": ("text 0\nä", None), "b.TXT": ("text 1\nä", None), "c.pdf": (None, "pages need a reader: pdf"), "d.exe": (None, "unsupported file type: exe")}


def test_dictionary_and_sinks(spark, tmp_path):
    (tmp_path / "names.txt").write_text("Spark\n\n  SQL \n")
    assert files.dictionary(spark, str(tmp_path / "names.txt"), ["x"]) == ["Spark", "SQL"]
    assert files.dictionary(spark, str(tmp_path / "none.txt"), ["x"]) == ["x"]
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    assert {r.value for r in spark.read.text(files.write_texts(df, str(tmp_path), "20240101")).collect()} == {"a", "b"}
    chat = spark.createDataFrame([("s1", [("u", "hi"), ("a", None)])], "id string, history array<struct<sender:string,message:string>>")
    files.write_sessions(chat, str(tmp_path / "sessions"))
    with open(tmp_path / "sessions" / "extra.json", "w") as f:
        f.write("not json\n")
    back = files.read_sessions(spark, str(tmp_path / "sessions"), "id string, history array<struct<sender:string,message:string>>")
    assert [(r.id, [tuple(h) for h in r.history]) for r in back.collect()] == [("s1", [("u", "hi"), ("a", None)])]
    made = files.case_file(spark.createDataFrame([("t", "x", "y")], "a string, b string, c string"), "a", "b", "c").first().value
    assert made.startswith("## t\n\n```\nx\n```") and made.endswith("y\n```\n")
