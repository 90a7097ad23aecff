"""The filter interaction audit against filters that are applied one after another."""

import itertools
import random
import re
from fractions import Fraction

from cairnspark.llm import filter_shapley as f
from cairnspark.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LABELS = "doc_id bigint, quality int, toxic int, part string"


def _fails(text: str, copy: bool) -> dict:
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}


def _audit(docs: list, labels: list) -> list[tuple]:
    """Each order applied to lists of documents."""
    rows = [(d.lang or "", d.doc_id, d.text or "") for d in docs]
    lowest: dict = {}
    for _, i, t in rows:
        if i is not None:
            lowest[t] = min(lowest.get(t, i), i)
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    parts: dict = {}
    for p, i, t in rows:
        parts.setdefault(p, []).append((i, _fails(t, i is not None and i > lowest[t])))
    out, total = [], {}
    for p, of in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = of
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                all_failing = [d for d in of if d[1][x]]
                alone = sum(sum(d[1].values()) == 1 for d in all_failing)
                total[p, x] = total.get((p, x), 0) + len(gone)
                lost = [sum(d[0] in s for d in gone) for s in (good, toxic)]
                out.append([p, "".join(order), step, len(left), len(gone), len(all_failing) - len(gone), alone, *lost])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def _got(docs, labels) -> list[tuple]:
    return sorted(map(tuple, f.audit(f.mask_counts(docs, labels)).collect()))


def test_rows_are_those_of_filters_one_after_another(spark, odd_docs, sf_dir):
    labels = [(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 1, None, "x"), (7, 1, 1, None), (None, 1, 1, "x"), (11, None, 1, "x"), (101, 1, 0, "x"), (999, 1, 1, "x")]
    table = spark.createDataFrame(labels, LABELS)
    assert _got(odd_docs, table) == _audit(odd_docs.collect(), labels)
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert _got(docs, marks) == _audit(docs.collect(), [(r.doc_id, r.quality, r.toxic) for r in marks.collect()])


def test_copies_of_repeated_and_missing_ids(spark, odd_docs):
    text = "some words that are shared"
    rows = [(3, text, None, 1), (3, text, "", 1), (5, text, "", 2), (None, text, "", 3), (5, None, "en", 4), (4, "", "en", 5), (None, None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, mask int")
    labels = spark.createDataFrame([], LABELS)
    got = _got(docs, labels)
    assert got == _audit(docs.collect(), [])
    alone = {r[0]: r[4] for r in got if r[1] == "EABCD" and r[2] == 1}
    assert alone == {"": 1, "en": 1}


def test_empty_table(spark, no_docs):
    assert f.audit(f.mask_counts(no_docs, spark.createDataFrame([], LABELS))).count() == 0


def test_polynomial_gives_survivors_and_shapley_values():
    r = random.Random(1)
    for n in (1, 3, 5):
        counts = {m: r.randrange(20) for m in range(1 << n)}
        poly = f.removal_polynomial(counts, n)
        for s in range(1 << n):
            assert f.corner(poly, s) == sum(c for m, c in counts.items() if m & s)
        for i in range(n):
            assert f.diagonal_integral(poly, i) == sum((Fraction(c, m.bit_count()) for m, c in counts.items() if m >> i & 1), Fraction(0))


def test_query_has_the_rows_of_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES["op11_filter_shapley"](spark, sf_dir).toArrow()
    want = con.sql(queries.ORACLE["op11_filter_shapley"]).to_arrow_table()
    names = want.column_names
    assert sorted(tuple(r[c] for c in names) for r in got.to_pylist()) == sorted(tuple(r[c] for c in names) for r in want.to_pylist())
