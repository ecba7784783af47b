import pytest

from glossa import errors
from glossa.sources.lexicon import Lexicon, first_violation, validated, violations

#: Lexicons with and without violations: (lexicon, entry_pos, base, alternatives or None).
BAD_LEXICONS = [
    (0, 0, "oak", ["elm"]), (0, 1, "oak", ["ash"]),
    (1, 0, "cat", ["lion", "lynx"]), (1, 1, "dog", ["wolf", "lynx"]),
    (2, 0, "red", ["pink", "rose"]), (2, 1, "blue", ["navy", "red"]),
    (3, 0, "run", ["jog", "dash"]), (3, 1, "dash", ["dart"]),
    (4, 0, "cold", ["chilly", "cold"]), (5, 0, "warm", []), (6, 0, "hot", None),
    (7, 0, "wet", ["damp", "moist", "damp"]), (8, 0, "good", ["fine", "fair"]),
    (9, 0, "a", ["b", "c"]), (9, 1, "d", ["c", "a"]), (9, 2, "e", []),
]


def lexicon(n):
    return [(b, a) for m, _, b, a in BAD_LEXICONS if m == n]


CASES = [
    (lexicon(0), errors.DuplicateBaseWordError), (lexicon(1), errors.DuplicateAlternativeError), (lexicon(2), errors.BaseInAlternativesError), (lexicon(3), errors.BaseInAlternativesError),
    (lexicon(4), errors.SelfReferentialAlternativeError), (lexicon(5), errors.EmptyAlternativesError), (lexicon(6), errors.MalformedLexiconError), (lexicon(7), errors.DuplicateAlternativeError),
    ([("sea", "lake")], errors.MalformedLexiconError), ([("sea", ["lake"]), ("lake", ["sea"])], errors.BaseInAlternativesError),
]


@pytest.mark.parametrize(("pairs", "error"), CASES)
def test_violations_are_typed(pairs, error):
    with pytest.raises(error):
        validated(pairs)


def test_shipped_lexicon():
    entries = Lexicon.default().entries
    assert len(entries) == 86 and sum(map(len, entries.values())) == 526
    assert first_violation(entries.items()) is None


def test_files(tmp_path):
    good, bad = tmp_path / "good.toml", tmp_path / "bad.toml"
    good.write_text('sea = ["ocean", "deep"]\n')
    bad.write_text('sea = ["ocean"')
    assert Lexicon.load(good).entries == {"sea": ["ocean", "deep"]}
    with pytest.raises(errors.MalformedLexiconError, match="bad.toml"):
        Lexicon.load(bad)
    with pytest.raises(FileNotFoundError):
        Lexicon.load(tmp_path / "none.toml")


def test_table_form_finds_the_same_violation(spark):
    df = spark.createDataFrame(BAD_LEXICONS, "lexicon bigint, entry_pos bigint, base string, alts array<string>")
    got = {r["lexicon"]: (r["entry"], r["rule"], r["word"]) for r in violations(df).collect()}
    lexicons = {n for n, *_ in BAD_LEXICONS}
    assert got == {n: v for n in lexicons if (v := first_violation([(b, a) for m, _, b, a in BAD_LEXICONS if m == n])) is not None}


def test_from_table(spark):
    df = spark.createDataFrame([("sea", ["ocean"]), ("hill", ["mound"])], "base string, alts array<string>")
    assert Lexicon.from_table(df).entries == {"hill": ["mound"], "sea": ["ocean"]}
