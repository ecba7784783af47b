"""What a choice replaces is cut out of the text once, and many words are halved by their first character."""

from glossa import apply_choices
from glossa.functions.patterns import any_of


def test_the_surface_is_taken_once_for_each_choice(spark):
    docs = spark.createDataFrame([(1, "Use it, USE it.")], "doc_id bigint, text string")
    choices = spark.createDataFrame([(1, 0, 3, "apply"), (1, 8, 11, "apply")], "doc_id bigint, start bigint, end bigint, replacement string")
    out = apply_choices(docs, choices)
    assert [r["revised"] for r in out.collect()] == ["Apply it, APPLY it."]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_join(slice(") <= 3  # a gap, a surface and what is left


def test_halved_words_are_all_found(spark):
    words = ["ask", "bask", "cask", "desk", "dusk", "k_9", "key", "task", "zoo"]
    pattern = any_of(words)
    df = spark.createDataFrame([(w,) for w in [*words, *(w.upper() for w in words), "asK", "xask", "asks", "dſk"]], "w string")
    assert [r["w"] for r in df.where(df.w.rlike(pattern)).collect()] == [*words, *(w.upper() for w in words), "asK"]
    assert "(?=[" in pattern
