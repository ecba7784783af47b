"""Spans, windows, suggestions, choices, prompts and sessions on literal texts."""

import re

import pytest
from pyspark.sql import functions as F

import glossa
from glossa.functions.context import block_cuts, boundaries, sentence_window
from glossa.functions.patterns import ABBREVIATIONS, PROTECTED, SPACE, WORD
from glossa.functions.spans import SENTINEL, find_all, merged, overlaps
from glossa.operators import review
from glossa.operators.apply import apply_choices, transfer_case
from glossa.operators.suggest import protected_spans, suggest
from glossa.plans.queries import PARAGRAPHS, corpus_lexicon
from glossa.sources.lexicon import Lexicon
from glossa.sources.texts import from_files, from_texts

MINI = Lexicon({
    "climb": ["scale", "mount"], "press": ["push", "squeeze", "bear on"], "bake": ["roast", "toast"],
    "glass": ["goblet", "tumbler"], "chat": ["talk", "natter"], "walk": ["stroll", "hike", "apply oneself"], "plant": ["sow", "seed"],
})
SESSION = Lexicon({"walk": ["hike", "march"], "cook": ["roast", "boil"], "bake": ["roast over", "toast"], "press": ["push", "bear on"]})
TEXTS = ["", "plain", "a\nb\r\nc", "one.  Two! Three? é É. Ω", "tab\tx\x1cy z w", "😀 use 😀 it", f"x{SENTINEL}use y use", *(p.replace("\\n", "\n").replace("\\t", "\t") for p in PARAGRAPHS)]


def spans(spark, texts, column):
    return [[tuple(x) for x in r[0]] for r in from_texts(spark, texts).orderBy("doc_id").select(column).collect()]


PYTHON = {"fenced": re.compile(r"```.*?```", re.S), "indented": re.compile(r"^(?: {4}|\t).+$", re.M), "inline": re.compile(r"`[^`\n]+`"), "url": re.compile(r"https?://\S+")}


@pytest.mark.parametrize("kind", PROTECTED)
def test_patterns_and_offsets_are_pythons(spark, kind):
    got = spans(spark, TEXTS, find_all(F.col("text"), PROTECTED[kind]))
    assert [[tuple(m) for m in x] for x in got] == [[(*m.span(), m[0]) for m in PYTHON[kind].finditer(t)] for t in TEXTS]


def test_words_are_pythons(spark):
    got = spans(spark, TEXTS, find_all(F.col("text"), WORD))
    assert [[(a, b) for a, b, *_ in x] for x in got] == [[m.span() for m in re.finditer(r"\b\w+\b", t)] for t in TEXTS]


def test_space_class_is_pythons(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    got = {r["p"] for r in df.where(F.col("c").rlike(f"^{SPACE}\\z")).collect()}
    assert got == {p for p in points if re.fullmatch(r"\s", chr(p))}


@pytest.mark.parametrize(("text", "expected"), [
    ("", []), ("no code here", []), ("open `tick\nonly", []), ("See `ls -l` first", [(4, 11)]), ("```\nrun\n``` done", [(0, 11)]), ("at https://a.example/x?y=1 now", [(3, 26)]),
    ("Notes:\n\tlet x = 2\nEnd", [(7, 17)]), ("`a`http://b.c/d", [(0, 15)]), ("```x``` then `y`", [(0, 14)]),
])
def test_protected(spark, text, expected):
    assert spans(spark, [text], protected_spans(F.col("text")))[0] == expected


def test_merge_and_overlap(spark):
    df = spark.sql("SELECT transform(array(array(30L, 40L), array(10L, 20L), array(40L, 41L), array(12L, 15L)), x -> named_struct('start', x[0], 'end', x[1])) AS s")
    assert [tuple(x) for x in df.select(merged(F.col("s"))).first()[0]] == [(10, 20), (30, 41)]
    cases = {(20, 30): False, (0, 3): False, (8, 9): False, (7, 12): True, (0, 4): True, (5, 6): True}
    for (a, b), hit in cases.items():
        assert df.select(overlaps(F.lit(a), F.lit(b), F.expr("array(named_struct('start', 3L, 'end', 8L))"))).first()[0] is hit


def window(spark, text, offset):
    n = F.length("text").cast("long")
    w = sentence_window(F.lit(offset).cast("long"), n, boundaries(F.col("text")), block_cuts(F.col("text")))
    return tuple(from_texts(spark, [text]).select(w.alias("w")).first()["w"])


@pytest.mark.parametrize(("text", "offset", "expected"), [
    ("a line without any end", 4, (0, 22)), ("It rained. We left early.", 5, (0, 11)), ("It rained. We left early.", 11, (11, 25)), ("Wait! Come back soon.", 8, (6, 21)),
    ("It weighs 2.75. Then it fell.", 27, (16, 29)), ("Ab. Cde. Fghi. Jk.", 9, (9, 15)), ("", 0, (0, 0)), ("Rain fell. Snow came.", 21, (11, 21)),
    ("a\n\nb x\n\nc", 3, (3, 8)), ("They went no. Then", 0, (0, 18)), ("so on etc... Then", 0, (0, 13)), ("ok. É", 0, (0, 5)), ("x! Go\n\nblock", 9, (3, 12)), ("a\n\nb", 4, (0, 4)),
])
def test_windows(spark, text, offset, expected):
    assert window(spark, text, offset) == expected


@pytest.mark.parametrize("word", ABBREVIATIONS)
def test_abbreviations_do_not_end_sentences(spark, word):
    text = f"We met {word.upper()}. Underhill again."
    assert window(spark, text, 0) == (0, len(text))


def found(spark, text, lexicon=MINI):
    return [(r["surface"], r["base"], r["suffix"], r["alternatives"]) for r in suggest(from_texts(spark, [text]), lexicon).orderBy("match_ord").collect()]


def test_scan(spark):
    assert found(spark, "Goats climb the wall.") == [("climb", "climb", "", ["scale", "mount"])]
    assert found(spark, "He was baking bread.") == [("baking", "bake", "-ing", ["roasting", "toasting"])]
    assert [x[:3] for x in found(spark, "They keep planting near glass.")] == [("planting", "plant", "-ing"), ("glass", "glass", "")]
    assert found(spark, "Old glass is uneven.")[0][2] == ""
    assert found(spark, "A weight presses the lid.")[0][3] == ["pushes", "squeezes"]
    assert [x[0] for x in found(spark, "chat/CHAT/Chat/cHaT")] == ["chat", "CHAT", "Chat", "cHaT"]
    assert len(found(spark, "a glass-topped table")) == 1 and len(found(spark, "glass_top eyeglass églass")) == 0
    assert found(spark, "") == [] == found(spark, "Nothing of it occurs in this line.")
    assert [x[0] for x in found(spark, "glass\n```\nglass\n```\n    glass\n`glass` https://glass.example")] == ["glass"]


def test_offsets_of_many_matches_take_linear_time(spark):
    """100,000 matches in one text: offsets, protected regions, windows and choices."""
    import time

    def took(n):
        docs = from_texts(spark, ["Glass. And `x` " * n])
        t = time.perf_counter()
        m = suggest(docs, MINI, context=True)
        assert m.selectExpr("count(*) AS n", "max(`end`) AS e", "max(win_end) AS w", "sum(length(sentence)) AS s").first() == (n, 15 * n - 10, 15 * n - 8, 7 * n + 8 * (n - 1))
        made = m.select("doc_id", "start", "end", F.lit("goblet").alias("replacement"))
        assert apply_choices(docs, made).select(F.md5("revised")).first()[0] == __import__("hashlib").md5(("Goblet. And `x` " * n).encode()).hexdigest()
        return time.perf_counter() - t

    few = took(5_000)
    assert took(100_000) < 40 * few


def test_alternatives_never_trigger(spark):
    lexicon = Lexicon.default()
    texts = [a for x in lexicon.entries.values() for a in x]
    assert suggest(from_texts(spark, texts), lexicon).count() == 0


def test_case_folding_is_lowers(spark):
    # Patterns fold the long s and the Kelvin sign; lower() folds the second alone.
    lexicon = Lexicon({"ask": ["beg"], "use": ["apply"]})
    assert [x[0] for x in found(spark, "aſk asK uſe", lexicon)] == ["asK"]


def test_words_beyond_ascii(spark):
    lexicon = Lexicon({"fenêtre": ["ouverture"], "use": ["apply"]})
    assert [x[0] for x in found(spark, "Fenêtre FENÊTRE fenêtres use fenêtrex", lexicon)] == ["Fenêtre", "FENÊTRE", "fenêtres", "use"]


def test_plan_has_no_shuffle_and_no_python(spark):
    df = suggest(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("use").alias("text")), corpus_lexicon(), context=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    assert not re.search(r"(?<!Broadcast)Exchange (hash|range|Single)", plan)


@pytest.mark.parametrize(("surface", "replacement", "expected"), [
    ("glass", "goblet", "goblet"), ("Glass", "goblet", "Goblet"), ("GLASS", "goblet", "GOBLET"), ("G", "goblet", "GOBLET"), ("g", "goblet", "goblet"), ("gLAss", "goblet", "goblet"),
    ("Press", "bear on", "Bear on"), ("PRESS", "bear on", "BEAR ON"), ("TRY", "low-key", "LOW-KEY"), ("GlAsS", "goblet", "Goblet"), ("3d", "goblet", "goblet"),
])
def test_case_transfer(spark, surface, replacement, expected):
    assert spark.range(1).select(transfer_case(F.lit(surface), F.lit(replacement))).first()[0] == expected


@pytest.mark.parametrize(("text", "choices", "expected"), [
    ("Glass, on a shelf.", [((0, 5), "goblet")], "Goblet, on a shelf."), ("No GLASS.", [((3, 8), "goblet")], "No GOBLET."),
    ("see glass and press", [((4, 9), "goblet"), ((14, 19), "push")], "see goblet and push"), ("glasspress", [((0, 5), "goblet"), ((5, 10), "push")], "gobletpush"),
    ("One glass.\n\nThen press on.\n", [((4, 9), "goblet"), ((17, 22), "push")], "One goblet.\n\nThen push on.\n"), ("a\t\n\n  b 😀 ", [], "a\t\n\n  b 😀 "),
    ("😀 glass é", [((2, 7), "goblet")], "😀 goblet é"),
])
def test_apply(spark, text, choices, expected):
    assert glossa.apply_choices(text, choices) == expected


def test_apply_validates(spark):
    with pytest.raises(ValueError, match="document order"):
        glossa.apply_choices("see glass and press", [((14, 19), "x"), ((4, 9), "y")])
    with pytest.raises(ValueError, match="overlap"):
        glossa.apply_choices("glasses", [((0, 5), "x"), ((3, 7), "y")])
    made = spark.createDataFrame([(1, 0, 5, "x"), (1, 3, 7, "y")], "doc_id long, start long, end long, replacement string")
    with pytest.raises(Exception, match="choices overlap .document 1."):
        apply_choices(from_texts(spark, ["a", "glasses"]), made).collect()


@pytest.mark.parametrize("line", ["", "0", "7", "+3", "-0", "-2", "007", "1_0", "1__0", "_1", "1_", "٣", "１２", "+", "- 1", "1 0", "1.0", "x", "99999999999", "0000000000001", "²", "  4\t"])
def test_numbers_are_pythons(spark, line):
    """The column reads what int() reads, but for numbers far beyond any option, which are -1."""
    got = spark.createDataFrame([(line,)], "l string").select(review.number(review.stripped(F.col("l")))).first()[0]
    try:
        want = int(line)
    except ValueError:
        want = None
    assert got == (want if want is None or abs(want) < 10**9 else -1)


def test_documents_without_choices_survive(spark):
    docs = from_texts(spark, ["a b", "use"])
    made = spark.createDataFrame([(1, 0, 3, "apply")], "doc_id long, start long, end long, replacement string")
    assert {tuple(r) for r in apply_choices(docs, made).collect()} == {(0, "a b"), (1, "apply")}


SESSIONS = [
    ("We walk home.", ["1"], "We hike home.", 0), ("We walk home.", ["2"], "We march home.", 0), ("We walk home.", ["0"], "We walk home.", 0), ("We walk. You walk.", ["1", ""], "We hike. You hike.", 0),
    ("We walk home.", [""], "We walk home.", 0), ("We walk. You walk. They walk.", ["1", "0", ""], "We hike. You walk. They hike.", 0),
    ("We bake. Baking takes time.", ["2", ""], "We toast. Toasting takes time.", 0), ("They press it. She presses it.", ["2", ""], "They bear on it. She presses it.", 0),
    ("We walk home.", ["abc", "99", " 1 "], "We hike home.", 0), ("We walk and cook.", ["1", "^C"], "We hike and cook.", 130), ("We WALK home.", ["1"], "We HIKE home.", 0), ("Walk home.", ["1"], "Hike home.", 0), ("nothing", [], "nothing", 0),
]


def test_sessions_by_lines(spark):
    docs = from_texts(spark, [t for t, *_ in SESSIONS])
    lines = spark.createDataFrame([(i, k, x) for i, (_, ls, *_) in enumerate(SESSIONS) for k, x in enumerate(ls)], "doc_id long, line_no int, line string")
    got = {r["doc_id"]: (r["revised"], r["exit_code"]) for r in review.replay_lines(docs, suggest(docs, SESSION), lines).collect()}
    assert got == {i: (revised, code) for i, (*_, revised, code) in enumerate(SESSIONS)}


def test_replay_by_match_agrees(spark):
    rows = [(t, ls, r, c) for t, ls, r, c in SESSIONS if "abc" not in ls]
    docs = from_texts(spark, [t for t, *_ in rows])
    lines = spark.createDataFrame([(i, k, x) for i, (_, ls, *_) in enumerate(rows) for k, x in enumerate(ls)], "doc_id long, match_ord int, line string")
    got = {r["doc_id"]: (r["revised"], r["exit_code"]) for r in review.replay(docs, suggest(docs, SESSION), lines).collect()}
    assert got == {i: (r, c) for i, (_, _, r, c) in enumerate(rows)}


def shown(spark, sentence, a, b, alts, default=None, color=False):
    df = spark.createDataFrame([(sentence, alts)], "s string, alts array<string>")
    return df.select(review.prompt(F.col("s"), F.lit(a), F.lit(b), F.col("alts"), None if default is None else F.lit(default), color)).first()[0]


def test_prompts(spark):
    assert shown(spark, "A taller tree.\n", 2, 8, ["higher", "bigger"], 2) == "A taller tree.\n  ^^^^^^\n  0) NO CHANGE\n  1) higher\n  2) bigger [default]\n"
    assert "A \x1b[1mtaller\x1b[0m tree." in shown(spark, "A taller tree.", 2, 8, ["higher"], color=True)
    assert "0) NO CHANGE [default]" in shown(spark, "Tree", 0, 4, [], 0)
    assert shown(spark, "A tree", 2, 2, []).split("\n")[1] == "  ^"


def test_stream_equals_batch(spark, tmp_path):
    from glossa.streaming.suggest import documents_stream, suggest_stream

    docs = from_texts(spark, [p.replace("\\n", "\n") for p in PARAGRAPHS])
    docs.write.parquet(str(tmp_path / "in"))
    suggest_stream(documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt"), corpus_lexicon(), context=True).awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), suggest(docs, corpus_lexicon(), context=True)
    assert got.count() == want.count() > 20 and got.exceptAll(want).isEmpty()


def test_public_api(spark):
    assert glossa.__all__ == ["Lexicon", "Match", "apply_choices", "suggest"]
    m = glossa.suggest("Baking it", SESSION)
    assert m == [glossa.Match((0, 6), "Baking", "bake", "-ing", ["toasting"])]


def test_files_are_strict_about_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    got = {r["path"][-5:]: (r["text"], r["valid"]) for r in from_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("é\nb\nc", True), "b.txt": (None, False)}


def test_line_ends_of_files_are_folded_without_patterns(spark, tmp_path):
    """A pattern copies a file's text several times, which a large one has no memory for."""
    (tmp_path / "a.txt").write_bytes(b"\r\r\n\n\ra\r\r")
    got = from_files(spark, str(tmp_path))
    assert "regexp" not in got._jdf.queryExecution().toString()
    assert got.first()["text"] == "\n\n\n\na\n\n"


@pytest.mark.parametrize(("name", "scans"), [("lexicon_violations", 1), ("decisions_parsed", 1), ("remembered_defaults", 1), ("case_transfer", 1), ("session_replay", 2)])
def test_documents_are_looked_through_once(spark, name, scans):
    from glossa.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == scans
