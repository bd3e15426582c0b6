"""Italic titles and other works' sentences, by hand and against plain Python over whole pages."""

import random
import re
import unicodedata

from docsieve.functions.wikitext import marked_text
from docsieve.operators import work_scope as W

STOP = {"the", "and", "for"}


def norm(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    s = re.sub(r"(?:\s*(?:\([^)]*\)|\[[^\]]*\]))+\s*$", "", s)
    return " ".join(re.sub(r"[^\w\s]|_", " ", re.sub(r"([^\W\d_])-(\d)", r"\1\2", s)).split())


def name_of(s):
    return re.sub("^the ", "", norm(s))


def test_marked_text():
    nested = "A<ref>x<ref>y</ref></ref> B<!-- c <!-- d --> {{lang|ja|''Oto''}}{{cite|{{a}}}} [[File:x.png|thumb|a [[b]] c]][[Some Game#Plot|it]] {{'}}s <i>t</i>{| table |} '''''Own''''' '''b''' {{open"
    got = marked_text(nested)
    assert "\x01Oto\x02" in got and "[[Some Game#Plot\x03it]]" in got and "'s t" in got and "\x01\x04Own\x02 b {{open" in got
    assert not any(x in got for x in ("cite", "thumb", "table", "<", "ref"))
    assert marked_text("<b>x</b <i>y>") == "xy" and marked_text("<re<!-- -->f>a</ref>b") == "b" and marked_text(None) == ""


def test_italic_sentences(spark):
    text = "== Head ==\n'''''[[Some Game]]''''' is ''[[Other Game (film)#Cast|Other]]''. ''Third'' [https://x.y site] follows.\n\n* A line with [[Place#At]] alone"
    got = [(r.para, r.k, r.text, [tuple(w) for w in r.works]) for r in W.italic_sentences(spark.createDataFrame([(1, text), (2, None)], "id long, m string"), "id", "m").collect()]
    assert sorted(got) == [
        (1, 0, "Some Game is Other.", [("Some Game", "Some Game", True), ("Other", "Other Game (film)", False)]),
        (1, 1, "Third site follows.", [("Third", "", False)]),
        (3, 0, "A line with Place alone", []),
    ]


def test_requested_names(spark):
    rows = [(1, "Some Mansion: Dark Moon HD", "Music of Some Mansion"), (2, "Some Red, Blue and Yellow", "Some (video game)"), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, game string, page string")
    wiki = W.italic_sentences(spark.createDataFrame([(1, "'''''The Moon Two''''' here.\n'''''Late''''' there.")], "id long, m string"), "id", "m")
    got = {r.id: r.names for r in W.requested_names(df, "id", "game", "page", wiki).collect()}
    assert got[1] == sorted(["some mansion dark moon hd", "some mansion dark moon", "some mansion", "dark moon", "dark moon hd", "moon two"])
    assert {"blue", "some red", "red and blue", "red and yellow", "blue and yellow", "some blue"} <= set(got[2]) and 3 not in got


TITLES = ["Some Quest", "Some Quest Zero", "Some Quest Original Soundtrack", "Other Saga", "Quest Saga", "Some"]
BODY = ["music was written in a week", "band recorded many songs for it", "critics praised its lively melodies", "remake of Some Quest came later", "sold a million copies worldwide quickly", "early Some games were harder than others"]


def page_of(rng):
    """Lines as (plain, wikitext)."""
    out = [("Some Quest is a game of many parts.", "'''''Some Quest''''' is a game of many parts.")]
    for _ in range(rng.randint(1, 12)):
        if rng.random() < 0.25:
            mark, title = "=" * rng.randint(2, 4), rng.choice([*TITLES, "Sequels", "Music"])
            out.append((f"{mark} {title} {mark}",) * 2)
            continue
        plain, wiki = [], []
        for _ in range(rng.randint(1, 4)):
            lead, body, title = rng.choice(["The", "It", "Its", "In 1999, the game was", "The remake", "A later"]), rng.choice(BODY), rng.choice([*TITLES, None])
            shown = "" if title is None else f" with {title}"
            linked = "" if title is None else " with " + rng.choice([f"''{title}''", f"''[[{title}]]''", f"''[[{title} (film)|{title}]]''", title])
            plain.append(f"{lead} {body}{shown}.")
            wiki.append(f"{lead} {body}{linked}.<ref>x</ref>")
        out.append((" ".join(plain), " ".join(wiki)))
    return "\n".join(p for p, _ in out), "\n".join(w for _, w in out)


def brute(full, wiki, names, game, page):
    own = {w for n in names for w in n.split() if len(w) >= 4 and w not in W.GENERIC_WORDS}
    related = lambda t: any(w in own for w in norm(t).split() if len(w) >= 4 and w not in W.GENERIC_WORDS)
    tokens = lambda s: {w for w in re.split(r"[\W_]+", s.lower()) if len(w) > 2 and w not in STOP}
    works = [w for _, ws in wiki for w in ws]
    games = {name_of(t) for t, _ in works if name_of(t) not in names and not re.search(W.MUSIC_ALBUM, t) and related(t)}

    def requested(t, to):
        n = f" {name_of(t)} "
        album = any(" " in x and f" {x} " in n for x in names) and re.search(W.MUSIC_ALBUM, t) and not re.search(W.NOT_MUSIC_ALBUM, t) and not any(f" {g} " in n for g in games)
        q = (re.search(r"\(([^()]*)\)\s*$", to) or [None, ""])[1].lower()
        return bool(album) or (name_of(to) in names or (name_of(re.sub(r"\s*\([^)]*\)\s*$", "", to)) in names and q in ("", page)) if to else name_of(t) in names)

    other_titles = {name_of(t) for t, to in works if not requested(t, to) and related(t)}
    stack, out = [], []
    for at, line in enumerate(full.split("\n")):
        m = re.fullmatch(r"(={2,6})\s*(.*?)\s*={2,6}", line)
        if m:
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            h = name_of(m[2])
            stack.append((len(m[1]), (h in other_titles and h not in names) or bool(re.search(W.EDITION_HEADING, m[2]))))
            continue
        carry = False
        for k, s in enumerate(re.split(r"(?<=[.!?])\s+(?=[A-Z])", line)):
            if any(x for _, x in stack):
                out.append((at, k, s))
                continue
            fits = [(len(tokens(s) & tokens(t)) / max(len(tokens(s)), len(tokens(t))), -i) for i, (t, _) in enumerate(wiki)] if len(tokens(s)) >= 4 else []
            best = max(fits, default=(0, 0))
            ws = wiki[-best[1]][1] if best[0] >= 0.5 else []
            series = lambda t, to: bool(re.search(r"(?i)\b(series|franchise)\b", to)) or (" " not in name_of(t) and any(n.startswith(name_of(t) + " ") for n in names)) or bool(re.search("(?i)" + re.escape(t) + W.OF_SERIES, s))
            others = any(not requested(*w) and not series(*w) and related(w[0]) for w in ws)
            clean, edition = W.named_plainly(norm(s), [*names, *(name_of(t) for t, to in ws if requested(t, to))], [norm(t) for t, to in ws if not requested(t, to)], "" if name_of(game) == "some quest" else name_of(game))
            names_it = clean or (not carry and not edition and bool(re.search(W.SUBJECT_LED, s)))
            carry = (others and not names_it) or (not names_it and bool(re.search(W.EDITION_LED, s) or edition)) or (carry and not names_it and not ws and bool(re.search(W.LEANS_BACK, s)))
            if carry:
                out.append((at, k, s))
    return sorted(out)


def test_other_work_sentences(spark):
    rng = random.Random(21)
    rows = [(i, *page_of(rng), rng.choice(["Some Quest", "Some Quest Zero"]), "Some Quest (video game)") for i in range(120)]
    df = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "It is. It was.", None, "x y z", "x")], "id long, full string, markup string, game string, page string").repartition(3)
    got = {}
    for r in W.other_work_sentences(df, "id", "full", "markup", "game", "page").collect():
        got.setdefault(r.id, []).append((r.line, r.k, r.sentence))
    wiki = W.italic_sentences(df, "id", "markup")
    held = {}
    for r in wiki.orderBy("id", "para", "k").collect():
        held.setdefault(r.id, []).append((r.text, [(w.title, w.target) for w in r.works]))
    names = {r.id: r.names for r in W.requested_names(df, "id", "game", "page", wiki).collect()}
    for i, full, _, game, _ in rows:
        assert sorted(got.get(i, [])) == brute(full, held[i], names[i], game, "video game"), i
    assert 50 < sum(map(len, got.values())) and 900 not in got and 901 not in got


def test_named_plainly():
    assert W.named_plainly("the music of some quest zero", ["some quest"], ["some quest zero"], "") == (False, False)
    assert W.named_plainly("a remake of some quest came", ["some quest"], [], "") == (False, True)
    assert W.named_plainly("some quest some quest hd", ["some quest"], [], "") == (True, True)
    assert W.named_plainly("red is here", ["red"], [], "") == (False, False)


def test_no_table_of_pages_is_broadcast(spark):
    df = spark.createDataFrame([(i, "Lake Song is a game. It has Moon Party fans in it.", "''Lake Song'' is a game. It has ''Moon Party'' fans in it.", "Lake Song", "Lake Song") for i in range(40)], "id long, full string, markup string, game string, page string")
    plan = W.other_work_sentences(df, "id", "full", "markup", "game", "page")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_aligned_shuffles_sentences_once(spark):
    """Places equal those of all pairs, and no tokens, candidates or postings are exchanged one by one."""
    rng = random.Random(8)
    some = lambda: " ".join(rng.choices([f"word{i}" for i in range(14)] + ["né"], k=rng.randint(1, 9)))
    wiki = [(i, p, k, some()) for i in range(12) for p in range(6) for k in range(3)]
    ours = [(i, p, k, some()) for i in range(13) for p in range(8) for k in range(4)]
    wiki.append((None, 0, 0, "word1 word2 word3 word4"))
    ours.append((None, 0, 0, "word1 word2 word3 word4"))
    w = spark.createDataFrame(wiki, "id long, para int, k int, text string").repartition(3)
    p = spark.createDataFrame(ours, "id long, line int, k int, sentence string").repartition(3)
    out = W._aligned(p, w, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, line, k, s in ours:
        t = {x for x in s.split() if len(x) > 2}
        fits = [(len(t & u) / max(len(t), len(u)), -para, -at) for j, para, at, x in wiki if i is not None and j == i and len(t) >= 4 and (u := {y for y in x.split() if len(y) > 2})]
        best = max(fits, default=(0, 0, 0))
        want |= {(i, line, k, -best[1], -best[2])} if best[0] >= 0.5 else set()
    assert {tuple(r) for r in out.collect()} == want and len(want) > 50
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
