"""The replay of raw lines: walks of many documents in a batch, and lines that come with the matches."""


from glossa import Lexicon
from glossa.operators import review
from glossa.operators.suggest import suggest


def test_lines_of_matches_walk_like_a_table_of_lines(spark):
    docs = spark.createDataFrame([(1, "Use it, use it, used."), (2, "use"), (3, None), (4, "none")], "doc_id bigint, text string")
    matches = suggest(docs, Lexicon({"use": ["apply", "employ"]}))
    lines = [(1, 0, "x"), (1, 1, "2"), (1, 2, ""), (1, 3, "^C"), (2, 0, "3"), (2, 1, "٢")]
    apart = review.replay_lines(docs, matches, spark.createDataFrame(lines, "doc_id bigint, line_no bigint, line string"))
    own = {(1, 0): lines[:2], (1, 1): lines[2:3], (1, 2): lines[3:4], (2, 0): lines[4:]}
    typed = spark.createDataFrame([(d, m, [x[1:] for x in ls]) for (d, m), ls in own.items()], "doc_id bigint, match_ord int, typed array<struct<line_no:bigint,line:string>>")
    together = review.replay_lines(docs, matches.join(typed, ["doc_id", "match_ord"]))
    expected = [(1, "Employ it, employ it, used.", 130, 1), (2, "employ", 0, 1), (3, None, 0, 0), (4, "none", 0, 0)]
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, together.collect())) == expected
    for df in (apart, together):
        assert "CoGroup" not in df._jdf.queryExecution().optimizedPlan().toString()  # a group of Python for each document
