"""Articles on several works against plain Python that walks the lines with a stack."""

import random
import re
import unicodedata

import pytest

from docsieve.operators import sections as X
from docsieve.operators import series as S

NAMES = ["Some Quest", "Some Quest Zero", "Other Quest", "Lake", "Lake Party", "History", "References", "Some Quest 2", '"Lake Song"', "North Lake"]


def norm(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    s = re.sub(r"(?:\s*(?:\([^)]*\)|\[[^\]]*\]))+\s*$", "", s)
    return " ".join(re.sub(r"[^\w\s]|_", " ", re.sub(r"([^\W\d_])-(\d)", r"\1\2", s)).split())


def article(rng):
    out = []
    for _ in range(rng.randint(0, 25)):
        if rng.random() < 0.45:
            mark = "=" * rng.randint(2, 5)
            out.append(f"{mark} {rng.choice(NAMES)} {mark}")
        else:
            about = [rng.choice([*NAMES, "Nobody", "the Some Quest series", "Äther-3"]) for _ in range(rng.randint(1, 4))]
            out.append(" ".join(f"The music of {a} was written in a week{rng.choice(['.', '!', '', '.”'])}" for a in about))
    return "\n".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(12)
    rows = [(k, article(rng), rng.choice(NAMES[:4] + ["Some Quest (game)", ""]), rng.choice(["Lake: Morning", "Lake Party: x", "Nowhere: Song", "theme", "Nobody", "None"])) for k in range(250)]
    rows += [(900 + k, "A soundtrack in parts.\n" + article(rng), "Lake", "Nowhere: Song") for k in range(60)]
    rows += [(1000, None, "Lake", "x"), (1001, "", None, None), (1002, "== Lake ==", "Lake", "Lake"), (1003, "Lead only. Nothing else is here at all.", "Lake", "Lake")]
    return rows, spark.createDataFrame(rows, "id long, text string, game string, track string").repartition(3)


def tree(lines):
    heads = [(i, len(m[1]), m[2]) for i, x in enumerate(lines) if (m := re.fullmatch(r"(={2,6})\s*(.*?)\s*={2,6}", x))]
    return [(h, n, i, next((j for j, m, _ in heads if j > i and m <= n), len(lines))) for i, n, h in heads]


def test_heading_tree(pages):
    rows, df = pages
    got = {}
    for r in X.heading_tree(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.heading, r.level, r["from"], r.to))
    for k, text, *_ in rows:
        assert sorted(got.get(k, [])) == sorted(tree((text or "").split("\n")))


def sentences(line):
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÄ])|(?<=[.!?]”)\s+(?=[A-ZÄ])", line.strip()) if len(s) >= 25 and re.search(r"[.!?][\"”)]?$", s)]


def brute_scope(text, game, track):
    text, g, t = text or "", norm(game or ""), norm(track or "")
    lead, *rest = re.split(r"\n(?===)", text)
    if text.startswith("=="):
        lead, rest = "", [text.split("\n==")[0], *rest]
    others = [norm(m) for m in re.findall(r"(?m)^==+\s*([^=\n]+?)\s*==+\s*$", text) if norm(m).startswith(g + " ")]

    def keeps(s):
        words = f" {norm(s)} "
        if len(t) >= 5 and not re.search(S.GENERIC_TRACK, t) and f" {t} " in words:
            return True
        at = words.find(f" {g} ") if g else -1
        while at >= 0:
            after = words[at + 1 :]
            following = words[at + len(g) + 2 :].split(" ")[0]
            if not re.fullmatch(S.ANOTHER_ENTRY, following) and not any(after.startswith(o + " ") for o in others):
                return True
            at = words.find(f" {g} ", at + 1)
        return False

    kept = [s for line in lead.split("\n") for s in sentences(line) if keeps(s)]
    n, parts, stack = len(kept), [], []
    for chunk in rest:
        first, _, body = chunk.partition("\n")
        m = re.fullmatch(r"(==+)\s*([^=\n]+?)\s*==+\s*", first)
        while stack and stack[-1][0] >= len(m[1]):
            stack.pop()
        ours = norm(m[2]) == g or bool(stack and stack[-1][1])
        stack.append((len(m[1]), ours))
        if m[2] == "References":
            continue
        found = [s for line in body.split("\n") for s in sentences(line) if ours or keeps(s)]
        if found:
            n += len(found)
            parts.append(f"== {m[2]} ==\n{' '.join(found)}")
    return (lead if not text.startswith("==") else text.split("\n==")[0]).strip() if n < 2 else "\n\n".join([*([" ".join(kept)] if kept else []), *parts]), n


def test_series_scope(pages):
    rows, df = pages
    got = {r.id: (r.scope, r.kept) for r in S.series_scope(df, "id", "text", "game", "track").collect()}
    assert got == {k: brute_scope(text, game, track) for k, text, game, track in rows}
    assert len({n for _, n in got.values()}) > 4


def brute_part(text, track):
    lines, track = (text or "").split("\n"), track or ""
    parts = [(re.sub(r'^["“](.*)["”]$', r"\1", h), bool(re.match(r'^["“].*["”]$', h)), n, a, b) for h, n, a, b in tree(lines)]
    parts = [p for p in parts if not re.search(S.GENERIC_SECTION, p[0]) and len(p[0].split()) <= 5]
    fit = sorted((p for p in parts if len(norm(p[0])) >= 4 and f" {norm(p[0])} " in f" {norm(track)} "), key=lambda p: (-len(p[0]), p[3]))
    first = next((i for i, x in enumerate(lines) if x.startswith("==")), 0)
    if fit:
        h, _, _, a, b = fit[0]
        others = [p[0] for p in parts if not p[1] and not (p[3] >= a and p[4] <= b) and not (p[3] <= a and p[4] >= b)]
        return (h, "\n".join(lines[:first]).strip() + "\n\n" + "\n".join(lines[a:b]), list(dict.fromkeys(others))) if len(others) >= 2 else None
    named = [p for p in parts if not p[1]]
    m = re.match(r"([^:]{3,}):\s*\S", track)
    if not m or not re.search(r"(?i)\b(soundtracks?|score)\b", "\n".join(lines[:first])) or sum(p[2] == 2 for p in named) < 3 or f" {norm(m[1])} " in f" {norm(' '.join(lines))} ":
        return None
    return "", "\n".join(x for i, x in enumerate(lines) if not any(p[3] <= i < p[4] for p in named)).strip(), list(dict.fromkeys(p[0] for p in named))


def test_soundtrack_part(pages):
    rows, df = pages
    got = {r.id: (r.heading, r.part, r.others) for r in S.soundtrack_part(df, "id", "text", "track").collect()}
    assert got == {k: p for k, text, _, track in rows if (p := brute_part(text, track))}
    assert {bool(h) for h, _, _ in got.values()} == {True, False}


def test_series_wide(spark):
    dated = "A start.\n== A (1990) ==\n== B (1991) ==\n== a (1992) ==\n=== C (1993) ==="
    rows = [("Music of Some Quest", "x", "Some Quest", False), ("Music of the Other series", "x", "Some Quest", True), ("Some Quest", dated, "Some Quest", False), ("Some Quest soundtrack", dated, "Some Quest", True)]
    rows += [("Some Quest music", "The music of the Some Quest video game series is old. It is.", "Some Quest", True), ("Some Quest music", "Old. The music of the Some Quest series.", "Some Quest", False), ("Music of X", "x", "", False), (None, None, None, False)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id long, page string, text string, game string")
    got = {r.id: r.wide for r in S.series_wide(df, "id", "page", "text", "game").collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}
