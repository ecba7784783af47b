import hashlib
import re

import pytest
import xxhash

from glossa.llm import fingerprints as fp
from tests.llm.conftest import DOCS, make_docs


def h(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def shown(p):
    return " ".join(f"{a:08x}@{b}" for a, b in p)


def like(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def char_picks(text):
    """Hash and position of the smallest (rightmost) hash of every window of k-grams of code points."""
    s = re.sub(r"[ \t\n\x0b\f\r]+", "", text)
    grams = [h(s[i : i + fp.CHARS].encode()) >> 32 for i in range(max(len(s) - fp.CHARS + 1, 1))] if s else []
    out = []
    for i in range(max(len(grams) - fp.WINDOW + 1, 1) if grams else 0):
        best = min(range(i, min(i + fp.WINDOW, len(grams))), key=lambda j: (grams[j], -j))
        if (grams[best], best) not in out[-1:]:
            out.append((grams[best], best))
    return out


def expected(docs):
    """By id; docs in order: descending, null last."""
    for k, (i, t, _) in enumerate(docs):
        t, follower = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        own, other = char_picks(t), char_picks(edited)
        yield i, (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), like(own, other), like(own, char_picks(follower)))


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("least", [1 << 18, 2000])
def test_against_plain_python(spark, corpus, least, monkeypatch):
    """Whole texts, a very long one too, in few and in many buckets."""
    monkeypatch.setattr(fp, "LEAST_BYTES", least)
    monkeypatch.setattr(fp, "A_CORE", 20)
    docs = list({i: (i, t, s) for i, t, s in corpus}.values())
    docs += [(300, "a few short words and some others", "s"), (301, "a few short words and more", "s"), (302, "ab😀", "s"), (303, "日本語の文章は空白なしで書かれるので区切りがない", "s")]
    docs += [(400 + i, "aaaa bbbb " * i + "z" * (i % 14), "s") for i in range(30)] + [(500 + i, " " * i + "tie" * i, "s") for i in range(12)]
    got = {r["doc_id"]: r for r in fp.fingerprints(make_docs(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i, want in expected(sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))):
        assert [got[i][c] for c in COLUMNS[:4]] == list(want[:4])
        assert [got[i][c] for c in COLUMNS[4:]] == pytest.approx(want[4:])


def test_null_and_repeated_ids_spread(spark, monkeypatch):
    """Many rows without an id of their own, many of one text: several buckets, each row once, successors in order of text hash."""
    monkeypatch.setattr(fp, "LEAST_BYTES", 2000)
    rows = [(None, f"text number {i % 7} of many rows", "s") for i in range(300)] + [(7, "one text of one id", "s")] * 200 + [(9, f"another text {i}", "s") for i in range(50)]
    df = make_docs(spark, rows)
    sizes = [r["count"] for r in fp.with_successors(df).where("NOT ghost").groupBy("bucket").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 3 * len(rows) / len(sizes)
    got = fp.fingerprints(df).collect()
    signed = lambda t: (h(t.encode()) ^ 1 << 63) - (1 << 63)
    want = [(i, *w) for i, w in expected(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]))))]
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS[:4])) for r in got) == sorted((str(w[0]), *w[1:5]) for w in want)


def test_edges(spark):
    assert fp.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = fp.fingerprints(make_docs(spark, [(5, "one two three", "s")])).first()
    assert one["near_next"] == 1.0


def test_short_and_unspaced_texts_keep_picks(spark, tmp_path):
    text = "日本語の文章は空白なしで書かれるので区切りがない"
    make_docs(spark, [(4, text, "s"), (3, "新" + text, "s"), (2, "seven words of text in one line", "s"), (1, "nothing alike follows upon this text", "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.op4_fingerprints(spark, str(tmp_path)).collect()}
    assert got[4]["near_next"] > 0.5  # one code point before it
    assert got[2]["near_edited"] > 0 and got[2]["near_next"] == 0  # half of a short text
