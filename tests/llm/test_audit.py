"""The audit of filter orders against a plain loop over orders, and odd rows."""

import itertools
import re

import pytest

from massloom.llm.audit import audit_filters, audit_orders

DOCS = "doc_id long, text string, lang string, words string, row int, part string, kind int, id string"
LABELS = "doc_id long, quality int, toxic int, part string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x y", 1, "p", 2, "i") for r in rows], DOCS)


def plain(rows, labels):
    fails = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows),
        })
    good, toxic = ({d for d, *x, _ in labels if x[k] == 1} for k in (0, 1))
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                failing = sum(fails[i][f] for i in own)
                alone = sum(fails[i][f] and sum(fails[i].values()) == 1 for i in own)
                removed_by[f] += len(gone)
                lost = [sum(rows[i][0] in x for i in gone) for x in (good, toxic)]
                mine.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, *lost))
        out += [(*m, removed_by[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


WORDS = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, WORDS, "en"), (2, WORDS, "de"), (3, None, "en"), (4, "", None), (5, " \t\n", ""), (6, "A B", "en"), (7, "w " * 30000, "de"),
    (8, WORDS + " $", "en"), (9, "w " * 30000, "en"), (9, "w " * 30000, "en"), (9, "other", "en"), (None, WORDS, "en"), (None, WORDS, "en"),
    (0, "ABC" * 50000, "en"), (10, "x" * 200000, "de"), (-5, "# a", "fr"),
]
LABELED = [(1, 1, 0, "z"), (2, 1, 1, "z"), (2, 0, 0, "z"), (9, None, 1, "z"), (None, 1, 1, "z"), (77, 1, 1, "z"), (0, 0, None, "z")]


def test_odd_rows(spark):
    got = audit_filters(docs_of(spark, ROWS), spark.createDataFrame(LABELED, LABELS)).collect()
    assert sorted(map(tuple, got)) == plain(ROWS, LABELED)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert sorted(map(tuple, audit_filters(docs_of(spark, ROWS[:4]), none).collect())) == plain(ROWS[:4], [])
    assert audit_filters(docs_of(spark, []), none).count() == 0


def test_two_filters_of_ones_own(spark):
    ids = spark.createDataFrame([(i, 0, i, "p") for i in range(10)], "id long, row long, doc_id long, part string")
    failing = {"X": ids.where("id < 6").select("id", "row"), "Y": ids.where("id >= 4").select("id", "row")}
    failing["Y"] = failing["Y"].union(failing["Y"])
    out = {(r.filter_order, r.step): r for r in audit_orders(ids, failing, {"good": ids.where("id = 5")}).collect()}
    assert [(out["XY", k].kept, out["XY", k].removed, out["XY", k].redundant, out["XY", k].good_lost) for k in (1, 2)] == [(4, 6, 0, 1), (0, 4, 2, 0)]
    assert (out["YX", 2].unique_fails, out["YX", 2].shapley) == (4, 10)
    with pytest.raises(ValueError):
        audit_orders(ids, {}, {})


def test_joins_do_not_shuffle_the_listed_ids(spark):
    from massloom.llm.audit import survivors

    ids = spark.createDataFrame([(i, 0, i, "p") for i in range(10)], "id long, row long, doc_id long, part string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = survivors(ids, {x: ids.select("id", "row") for x in "ABC"}, {})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    below = plan[plan.index("SortMergeJoin") :]
    assert plan.count("LeftAnti") >= 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert below.index("Generate") < below.index("REPARTITION_BY_COL")  # listed after the shuffle
