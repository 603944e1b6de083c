"""Whole jobs of the operators: no row, keyword, note or occurrence is cut off."""


def test_pairs_have_all_keywords(spark):
    from scriptorium.operators.matching import asked_keywords, pairs

    often = [f"word{c}" for c in "abcdefghijkl"]
    asked = asked_keywords(spark.createDataFrame([(1, "Spark once, lonely " + " ".join(often * 2)), (2, "nothing twice")], "item_id int, text string"), "item_id")
    docs = spark.createDataFrame([(i, "spark worda wordl lonely") for i in range(8)] + [(90, "unrelated"), (91, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in pairs(docs, asked).collect()}
    assert sorted(got) == list(range(8))  # all documents, not the best five
    assert {(r.present, r.missing, r.score) for r in got.values()} == {("Spark,worda,wordl", ",".join(often[1:-1]), 23)}


def test_listing_has_all_applications_offers_first(spark):
    from scriptorium.operators.tracking import LISTED, listing

    states = [*LISTED, "unknown"]
    apps = spark.createDataFrame([(i, states[i % 7], None if i % 3 == 0 else f"2024-01-{i % 28 + 1:02d}") for i in range(350)], "app_id int, status string, applied_date string")
    got = listing(apps, today="2024-06-01").collect()
    assert len(got) == 350 and [r.priority for r in got] == sorted(r.priority for r in got)
    assert (got[0].status, got[-1].status, got[-1].priority) == ("offered", "unknown", 99)
    assert {r.date for r in got if r.app_id % 3 == 0} == {"2024-06-01"}
    assert [r.status for r in listing(apps, "applied").collect()] == ["applied"] * 50


def test_all_notes_stay_with_their_times(spark):
    from scriptorium.operators.tracking import noted

    e = spark.createDataFrame([(1, i, f"2024-01-{i:02d} 10:00:00", f"k{i}") for i in range(28, 0, -1)] + [(2, 1, "2024-02-01 00:00:01", None), (2, 2, None, "x")], "app_id int, seq int, ts string, kind string")
    got = {r.app_id: r for r in noted(e.withColumn("ts", e["ts"].cast("timestamp"))).collect()}
    assert got[1].n_notes == 28 and got[1].notes.split("\n") == [f"[2024-01-{i:02d} 10:00:00] k{i}" for i in range(1, 29)]
    assert got[2].notes.split("\n") == ["x", "[2024-02-01 00:00:01] "]


def test_every_occurrence_with_position_and_context(spark):
    import re

    from scriptorium.operators.layout import occurrences

    texts = ["the other the, bathe the", "", None, "no hit", "x" * 300 + " the " + "y" * 300 + "\nthe\n\n a.b", "the", "The THE the_ a.b axb the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.word, r.position, r.context) for r in occurrences(df, "doc_id", ["the", "a.b"]).collect())
    want = [(i, w, m.start(), t[max(0, m.start() - 100) : m.end() + 100].strip()) for i, t in enumerate(texts) if t for w in ("the", "a.b") for m in re.finditer(rf"\b{re.escape(w)}\b", t)]
    assert got == sorted(want) and len(got) == 10


def test_five_missing_skills_and_the_rest(spark):
    from scriptorium.operators.matching import missing_skills

    df = spark.createDataFrame([(1, "none of them"), (2, "Spark SQL Pandas Java Python"), (3, "")], "k int, t string")
    got = {r.k: (r.top_missing, r.more) for r in df.select("k", *missing_skills(df["t"])).collect()}
    assert got == {1: ("Spark,SQL,Pandas,Java,Python", 4), 2: ("Scala,Docker,Kubernetes,Linux", 0), 3: ("Spark,SQL,Pandas,Java,Python", 4)}


def test_skills_are_whole_words_and_texts_are_not_split(spark):
    import re

    from scriptorium.operators import matching

    texts = ["java", "JavaScript, xjava java_ 9java", "a-JAVA.b javajava", "java\r", "javajava java", "éjavaé\nSQL\tPANDAS", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.data, r.languages, r.platform) for r in df.select("doc_id", *matching.skill_columns(df["text"])).collect()}
    named = lambda t, s: s.lower() in re.split(r"[^A-Za-z0-9_]+", (t or "").lower())
    assert got == {i: tuple(",".join(sorted(s for s in names if named(t, s))) for names in matching.SKILLS.values()) for i, t in enumerate(texts)}
    for name in ("ag18_skills", "so6_missing"):
        # one split into lines makes the fixture; a split into words ran once for every skill
        assert matching.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
