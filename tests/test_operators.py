"""Folds, screening, markup, sources and streams against plain Python or by hand."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.functions import grounding as G
from docsieve.functions import text as T
from docsieve.functions.markup import plain
from docsieve.operators import selection as S
from docsieve.operators import set_pairs as P
from docsieve.operators import similarity as M
from docsieve.operators import state as K
from docsieve.operators.screening import screen
from docsieve.sources import readers, stores
from docsieve.streaming import keyed


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(1)
    rows = [(i, f"k{i % 3}", pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=rng.randint(0, 20_000)), rng.random()) for i in range(400)]
    return rows, spark.createDataFrame(pd.DataFrame(rows, columns=["id", "key", "at", "value"]))


def ordered(rows, key):
    return sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))


def test_hysteresis_and_anchor(readings):
    rows, df = readings
    busy = {r.key: (r.busy, r.turns) for r in K.hysteresis(df, "key", "at", "id", "value", 0.9, 0.6, 3).collect()}
    plays = {r.key: r.plays for r in K.anchored_counts(df, "key", "at", 600, "id").collect()}
    for key in busy:
        now, quiet, turns, anchor, n = False, 0, 0, None, 0
        for _, _, at, v in ordered(rows, key):
            quiet = quiet + 1 if now and v < 0.6 else 0
            new = True if v >= 0.9 else False if quiet >= 3 else now
            turns, now = turns + (new != now), new
            quiet = quiet if now else 0
            if anchor is None or (at - anchor).total_seconds() >= 600:
                anchor, n = at, n + 1
        assert busy[key] == (now, turns) and plays[key] == n


def test_pace_levels(readings):
    rows, df = readings
    seconds = lambda v: None if v > 0.93 else v * 100
    got = {r.key: (r.level, r.changes) for r in K.pace_levels(df.withColumn("s", F.when(F.col("value") <= 0.93, F.col("value") * 100)), "key", "at", "id", "s").collect()}
    for key in got:
        level, seen, changes = "full", [], 0
        for *_, v in ordered(rows, key):
            s = seconds(v)
            seen = [*seen, s][-3:]
            if s is None:
                new = "quick"
            elif level == "quick" and s <= 60:
                new = "short"
            elif level == "short" and len(seen) == 3 and all(x <= 30 for x in seen):
                new = "full"
            elif level == "full" and len(seen) >= 2 and sum(seen) / len(seen) > 60:
                new = "short"
            else:
                new = level
            if new != level or s is None:
                seen = []
            changes, level = changes + (new != level), new
        assert got[key] == (level, changes)


def test_packing_rotation_and_budget(spark):
    rows = [("a", i, "x" * n, k) for i, (n, k) in enumerate([(3, "p"), (4, "p"), (2, "q"), (9, "plain"), (1, "p"), (5, "q")])]
    df = spark.createDataFrame(rows, "g string, pos long, t string, kind string")
    assert [len(r.line) for r in K.packed_lines(df, "g", "pos", "t", 8).orderBy("nth").collect()] == [8, 2, 9, 7]
    assert [r["item"] for r in K.rotated(df, "g", "pos", "kind", "pos").orderBy("place").collect()] == [0, 2, 1, 3, 4, 5]
    assert sorted(r.pos for r in S.within_budget(df, "g", ["pos"], F.length("t"), 8).collect()) == [0, 1]
    assert sorted(r.pos for r in K.packed_within(df.withColumn("n", F.length("t")), "g", ["pos"], "n", 10).collect()) == [0, 1, 2, 4]


def test_rotated_equals_the_greedy_rule(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.choice(kinds)) for k, kinds in ((1, ["a", "b", "plain"]), (2, ["a"] * 9 + ["b", "plain"]), (None, ["a"])) for i in range(5000)]
    got = {}
    for r in K.rotated(spark.createDataFrame(rows, "g long, pos long, kind string").repartition(3), "g", "pos", "kind", "pos").orderBy("place").collect():
        got.setdefault(r.g, []).append(r["item"])
    for key in (1, 2, None):
        left, out, last = [(i, k) for g, i, k in rows if g == key], [], "plain"
        while left:
            at = next((n for n, (_, k) in enumerate(left) if last == "plain" or k != last), 0)
            i, last = left.pop(at)
            out.append(i)
        assert got[key] == out


def test_screening(spark):
    source = "Ada Lovelace wrote the first program in 1843 for a machine of brass"
    texts = ["Ada wrote 9 programs", "He wrote a program", "see https://x.y", "Ada met Grace there", "program machine brass zebra", "program machine brass first", "program machine brass first", "x" * 170]
    df = spark.createDataFrame([(1, i, t, source) for i, t in enumerate(texts)], "b long, pos long, caption string, source string")
    got = [r.reason for r in screen(df, "b", "pos").orderBy("pos").collect()]
    assert got == ["number", "pronoun", "link", "name", "replaced", None, "duplicate", "long"]
    quote = spark.createDataFrame([('she said "the first machine of brass"', source), ('"a machine of brass" it was', source)], "c string, s string")
    assert [r[0] for r in quote.select(G.altered_quote(F.col("c"), F.col("s"))).collect()] == [True, False]


def test_text_functions(spark):
    df = spark.createDataFrame([("  - Café  \x07 Noir ", "Café")], "t string, u string")
    got = df.select(T.clean_request(F.col("t")), T.without_markers(F.col("t")), T.fold_case("u"), F.round(T.contrast(T.luminance(*map(F.lit, (255, 255, 255))), T.luminance(*map(F.lit, (0, 0, 0)))), 6)).first()
    assert tuple(got) == ("- Café Noir", "Café  \x07 Noir", "cafe", 21.0)
    dates = spark.createDataFrame([("+1999-03-07T00:00:00Z", 11), ("+1999-03-00T00:00:00Z", 10), ("+1999-00-00T00:00:00Z", 9), ("nonsense", 11)], "d string, p int")
    assert [r[0] for r in dates.select(T.plain_date(F.col("d"), F.col("p"))).collect()] == ["7 March 1999", "March 1999", "1999", None]


def test_html():
    page = "<html><head><title>no</title></head><body><h1>A &amp; B</h1><nav><nav>x</nav>y</nav><h2>Life</h2><p>One<br>two<script>if (a<b) c</script></p><p>unclosed <b"
    assert plain(page).split("\n")[:4] == ["A & B", "== Life ==", "One", "two"] and plain(None) == "" and "x" not in plain(page)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf\n Some Band - A Song \n")
    assert readers.now_playing(spark, str(tmp_path)).first().song.asDict() == {"artist": "Some Band", "title": "A Song"}
    (tmp_path / "a.txt").write_bytes("﻿Just a title".encode("utf-16-le"))
    assert readers.now_playing(spark, str(tmp_path)).first().song.asDict() == {"artist": None, "title": "Just a title"}
    (tmp_path / "pack.json").write_text('{"lines": ["[rock] one", "two", "two"]}')
    assert sorted(tuple(r) for r in readers.topics(spark, str(tmp_path / "pack.json")).na.fill("").collect()) == [("", "two"), ("rock", "one")]
    (tmp_path / "e.jsonl").write_text('{"key": "k", "at": "2024-01-01T00:00:00"}\nbroken\n{"key": "k"}\n')
    assert readers.events(spark, str(tmp_path / "e.jsonl")).count() == 1


def test_streams(spark, readings, tmp_path):
    rows, df = readings
    df.select("key", "at", "value").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, at timestamp, value double").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    for name, out, mode in (("plays", keyed.anchored_plays(stream(), 600), "update"), ("spells", keyed.busy_spells(stream(), 0.9, 0.6, 3), "append"), ("windows", keyed.counts_by_window(stream(), "key"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    plays = {r.key: r.plays for r in K.anchored_counts(df, "key", "at", 600, "id").collect()}
    assert {r.key: r.plays for r in spark.sql("select key, max(plays) plays from plays group by key").collect()} == plays
    turns = {r.key: r.turns for r in K.hysteresis(df, "key", "at", "id", "value", 0.9, 0.6, 3).collect()}
    assert {r.key: r.n for r in spark.sql("select key, count(*) n from spells group by key").collect()} == turns
    assert spark.sql("select sum(n) from windows").first()[0] == len(rows)


def test_titles(spark):
    from docsieve.functions import titles as N

    df = spark.createDataFrame([("Sóng (Live) [Remastered 2009]", "Game: Theme", "Part II", "part 2", "JRR Tolkien")], "a string, b string, c string, d string, e string")
    w = lambda c: T.words_of(F.col(c))
    got = df.select(
        N.title_key(F.col("a")), N.without_version(F.col("a")), N.two_parts(F.col("b")), N.numerals_differ(w("c"), w("d")), N.is_initials(F.lit("J.T."), w("e")),
        N.initials_clash(F.array(F.lit("j"), F.lit("smith")), F.array(F.lit("karl"), F.lit("smith"))), N.mentions(F.col("b"), F.array(F.lit("theme"))), N.mentions(F.col("b"), F.array(F.lit("them"))), N.earliest_year(F.lit("in 2001, 1999 and 12345")),
    ).first()
    assert [x.asDict() if hasattr(x, "asDict") else x for x in got] == ["song", "Sóng", {"whole": "Game", "part": "Theme"}, True, True, True, True, False, 1999]


def test_sections(spark):
    from docsieve.operators import sections as X

    text = "Title\n== A ==\na1\n=== B ===\nb1\n== C ==\nc1"
    df = spark.createDataFrame([(1, text), (2, "plain")], "k long, t string")
    assert [tuple(r)[1:] for r in X.section_table(df, "k", "t").orderBy("from").collect()] == [("A", 2, 1, 5), ("B", 3, 3, 5), ("C", 2, 5, 7)]
    assert {r.k: (r.text, r.sections) for r in X.without_sections(df, "k", "t", "^A$").collect()} == {1: ("Title\n== C ==\nc1", 1), 2: ("plain", 0)}
    assert [(r.pos, r.under) for r in X.last_heading(X.line_table(df, "k", "t"), "k").where("k = 1").orderBy("pos").collect()] == [(0, None), (2, "A"), (4, "B"), (6, "C")]


def test_boxes(spark):
    from docsieve.functions import boxes as B

    markup = "x <!-- {{Infobox no}} -->{{Infobox song\n| name = ''A''<ref name=a>n</ref>\n| released = {{start date|1999|3}}\n| writer = [[P Q|Pat]], Sam\n| genre = {{hlist|[[Rock music|Rock]]|Pop}}\n| empty =\n}} tail"
    df = spark.createDataFrame([(1, markup), (2, "{{Infobox song | a = b"), (3, None)], "k long, m string").withColumn("b", B.box_of("m"))
    rows = {r.k: r for r in df.select("k", "b", B.facts_of(F.col("b")).alias("f")).collect()}
    assert rows[1].b.kind == "song" and rows[1].b.fields == {"name": "A", "released": "1999\n3", "writer": "Pat, Sam", "genre": "Rock\nPop"}
    assert rows[1].f == ["It came out in 1999, 3.", "Its genre is given as Rock, Pop.", "It was written by Pat, Sam."] and rows[2].b.kind is None and rows[3].b.kind is None
    said = df.where("k = 1").select(B.said_elsewhere(B.items_of(F.col("b")["fields"], "writer"), F.array(F.lit("by Pat"), F.lit("with sam")))).first()[0]
    assert said is True


def test_wider_checks(spark):
    source = "The album by Ada came out in March 1999. It was only partly recorded in 2001 and written by Sam."
    cases = {"Ada by album": "turned", "It came out in June": "month", "The album of 2001": "year", "It came out in March": "dropped-year", "because of Ada": "connective", "all except Ada": "exception", "Ada and sister": "relation", "Ada produced it": "role", "Ada won": "award", "The album": None}
    rows = [(c, source, source.split(". ")[:1]) for c in cases]
    df = spark.createDataFrame(rows, "c string, s string, r array<string>")
    assert {r.c: r.w for r in df.select("c", G.wider_reason(F.col("c"), F.col("s"), F.col("r")).alias("w")).collect()} == cases
    lost = spark.createDataFrame([("It was recorded in 2001", source, [source.split(". ")[1]])], "c string, s string, r array<string>")
    assert lost.select(G.wider_reason(F.col("c"), F.col("s"), F.col("r"))).first()[0] == "limit"


def test_uploads(spark):
    from docsieve.functions import uploads as V

    cases = [("Ada - Engine (Official Video)", "AdaVEVO", ("Ada", "Engine", True)), ("Engine - Ada", "Ada - Topic", ("Ada", "Engine", True)), ('Sam sings "Brass" live', "x", ("Sam sings", "Brass", False)), ("Engine [4K] | Lyrics HD", "Some Band Official", ("Some Band", "Engine", True)), ("A – B", "c", ("A", "B", False))]
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, t string, c string")
    assert [tuple(r.p) for r in df.select("i", V.upload_parts(F.col("t"), F.col("c")).alias("p")).orderBy("i").collect()] == [w for *_, w in cases]
    assert df.select(V.is_not_music(F.lit("My Podcast 3"))).first()[0] is True


def test_near_duplicates_of_all_documents(spark, monkeypatch):
    """Across sources, on two sides of a multiple of 400 characters, and a short text within a long one."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(120)]
    texts = [rng.sample(vocabulary, rng.randint(1, 60)) for _ in range(60)]
    texts += [x[: len(x) * 3 // 4] + ["other"] for x in texts[:15]] + [texts[20][:4], vocabulary[:100], vocabulary[10:20], vocabulary[10:20], ["other"], []]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)] + [(500, None)], "doc_id long, text string")
    sets = {}
    for i, x in enumerate(texts):
        sets.setdefault(frozenset(x), i)
    held = sorted((i, x) for x, i in sets.items() if x)
    want = []
    for k, (i, x) in enumerate(held):
        for j, y in held[k + 1 :]:
            both = len(x & y)
            if 2 * both >= len(x | y) or 10 * both >= 7 * min(len(x), len(y)):
                want.append((i, j, both, len(x), len(y)))
    assert len(want) > 50
    for hot in (4096, 3):
        monkeypatch.setattr(M, "HOT", hot)
        assert sorted(tuple(r) for r in M.near_duplicate_documents(docs).collect()) == want


def test_near_duplicates_shuffle_sets_and_no_candidates(spark, monkeypatch):
    """Sets of one frequent token make candidates of all pairs, which no exchange may hold; cells of small batches, large ones and null ones."""
    rows = [(i, f"b{i % 3}" if i % 10 else None, f"common usual xxx{i} yyy{i} " + ("same thing here too and more of it" if i % 7 == 0 else "")) for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id int, g string, text string")
    sets = {(g, i): frozenset(w for w in t.split() if len(w) > 2 and w != "and") for i, g, t in rows if g is not None}
    want = []
    for (g, i), x in sets.items():
        for (h, j), y in sets.items():
            if g == h and i < j and (2 * len(x & y) >= len(x | y) or 10 * len(x & y) >= 7 * min(len(x), len(y))):
                want.append((g, i, j, len(x & y), len(x), len(y)))
    assert len(want) > 50
    for hot, most in ((4096, 4_000_000), (5, 4_000_000), (4096, 50)):
        monkeypatch.setattr(M, "HOT", hot)
        monkeypatch.setattr(P, "MOST", most)
        pairs = M.near_duplicate_pairs(docs, "g")
        assert sorted(tuple(r) for r in pairs.collect()) == sorted(want) and dict(pairs.dtypes)["a"] == "int"
        assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString() and "array_intersect" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_sets_of_one_batch_among_many_are_not_copied(spark):
    """Batches that are a small part of the work are one cell, however many sets they have; one that is most of it is dealt over several."""
    sets = lambda rows: spark.createDataFrame([(f"b{b}", i, f"a{i} b", 2) for b, i in rows], "batch string, id long, tokens string, n int")
    even = P.cells(sets([(b, 100 * b + i) for b in range(40) for i in range(12)]), 5).collect()
    assert len(even) == 40 * 12 and all(len({r.cell for r in even if r.batch == b}) == 1 for b in {r.batch for r in even}) and len({r.cell for r in even}) == 40
    uneven = P.cells(sets([(0, i) for i in range(60)] + [(b, 100 * b) for b in range(1, 9)]), 5).collect()
    assert len({r.cell for r in uneven if r.batch == "b0"}) > 3 and len({r.cell for r in uneven if r.batch != "b0"}) == 1


def test_sets_of_one_corpus_are_written_once(spark, monkeypatch):
    """However many blocks the sets make, each is in one of them, and pairs are those of all sets."""
    rng = random.Random(11)
    texts = [" ".join(rng.sample([f"word{i}" for i in range(30)], rng.randint(1, 12))) for _ in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = {}
    for i, t in enumerate(texts):
        held.setdefault(frozenset(t.split()), i)
    held = [(i, x) for x, i in held.items()]
    want = sorted((min(i, j), max(i, j), len(x & y)) for k, (i, x) in enumerate(held) for j, y in held[k + 1 :] if 2 * len(x & y) >= len(x | y) or 10 * len(x & y) >= 7 * min(len(x), len(y)))
    monkeypatch.setattr(P, "MOST", 200)
    packed, n = P.blocks(M._token_sets(docs, F.lit("")), 4096)
    assert n >= 5 and sum(len(pa.ipc.open_stream(r.sets).read_all()) for r in packed.collect()) == len(held)
    out = M.near_duplicate_documents(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert sorted((r.a, r.b, r.both) for r in out.collect()) == want and len(want) > 50
    assert M.near_duplicate_documents(docs.where("doc_id < 0")).count() == 0


def test_all_orders_and_customers_take_part(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{d}/orders.parquet").count()
    assert entry.queries()["asof_revision_all"](spark, d).count() == orders
    met = entry.queries()["tiered_identity_join_all"](spark, d)
    assert met.count() == orders and met.where("c_custkey % 2 = 1 and tier = 0").count() > 0


def test_title_keys_read_whole_titles(spark, tmp_path):
    import __spark_entry__ as entry

    long = "a title of quite some words that goes on beyond sixty characters"
    docs = [(1, f"{long} one 1987 (live)"), (2, f"{long} two")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["title_keys_whole"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.key, r.year) for r in got] == [(f"{long} one 1987", 1987), (f"{long} two", None)]


def test_title_keys_are_those_of_the_sql(spark, tmp_path):
    """A letter between two years ends the first only; blanks, ends, marks and capitals are as in the SQL."""
    import duckdb

    import __spark_entry__ as entry

    titles = ["token 2e1999a1888b1777c 5", "1999 1888 (live)", "x 1888", "a b (live)\u2028", "a (live)\x0b", "ΟΔΟΣ Α\u0903β (live)\u00a0", "\u3000", "a\u20dd 각", None]
    spark.createDataFrame(list(enumerate(titles)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("title_keys", "title_keys_whole"):
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).orderBy("doc_id").collect()]
        assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall()) and [r[2] for r in got[:3]] == [1777, 1999, 1888] and len(got) == 7
