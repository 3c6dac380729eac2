import numpy as np
from pyspark.sql import functions as F

from granary.operators import mapping
from tests.conftest import rows_by
from workload.views import HEADERS


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def normal(name):
    """Walk the characters: runs of blanks and hyphens become one underscore, other marks go."""
    out, gap = "", False
    for c in name.strip().lower():
        if c == "-" or c.isspace():
            gap = True
            continue
        if gap:
            out, gap = out + "_", False
        if c == "_" or c.isalnum():
            out += c
    return out + "_" * gap


def score(name, field):
    name = normal(name)
    return max(
        200.0 * lcs(name, a) / (len(name) + len(a)) for a in [field, *mapping.ALIASES[field]]
    )


def claimed(columns, threshold=75.0, margin=5.0):
    """All pairs once in order of score; a pair is claimed while both its sides are free."""
    pairs = [(-score(c, f), k, i) for k, f in enumerate(mapping.FIELD_NAMES) for i, c in enumerate(columns)]
    worth = {(k, i): -s for s, k, i in pairs}
    taken, out = set(), {}
    for s, k, i in sorted(pairs):
        field = mapping.FIELD_NAMES[k]
        if -s < threshold or field in out or i in taken:
            continue
        near = [columns[d] for d in range(len(columns)) if d not in taken and d != i and -s - worth[k, d] <= margin]
        taken.add(i)
        out[field] = (columns[i], round(-s, 6), sorted(near))
    return out


def catalogue(spark, sources):
    rows = [(s, i, c) for s, cols in sources.items() for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "source_id string, position int, raw_column string")


def test_scores_match_brute_force(spark):
    names = HEADERS + ["", "price", "qty", "  Product--ID ", "x"]
    found = rows_by(mapping.column_scores(catalogue(spark, {"s": names})), "raw_column", "field")
    for name in names:
        for field in mapping.FIELD_NAMES:
            assert abs(found[(name, field)]["score"] - score(name, field)) < 1e-9, (name, field)


def test_suggestions_match_brute_force(spark):
    rng = np.random.default_rng(3)
    sources = {
        "shop": ["Item No", "Units Sold", "Sale Date", "Unit Price", "Loyalty Tier"],
        "twice": ["units", "units sold", "day", "product code", "item code"],
        "nothing": ["aaa", "zzz"],
        "copies": ["price", "price ", "PRICE", "unit price", "unit_price"] * 4,
    }
    for i in range(25):
        sources[f"r{i}"] = list(rng.choice(HEADERS, size=rng.integers(1, 14)))
    cat = catalogue(spark, sources)
    suggested = mapping.suggest_mappings(cat)
    found = rows_by(suggested, "source_id", "field")
    others = {}
    for r in mapping.mapping_rivals(cat).collect():
        assert abs(r["score"] - score(r["raw_column"], r["field"])) < 1e-9
        others.setdefault((r["source_id"], r["field"]), []).append(r["raw_column"])
    for source, columns in sources.items():
        want = claimed(columns)
        got = {f: r for (s, f), r in found.items() if s == source}
        assert set(got) == set(want), source
        for f, (column, value, rivals) in want.items():
            assert got[f]["raw_column"] == column
            assert round(got[f]["score"], 6) == value
            assert got[f]["rivals"] == len(rivals)
            assert sorted(others.get((source, f), [])) == rivals
            assert got[f]["status"] == ("ambiguous" if rivals else "mapped")
    free = mapping.unmapped_columns(cat.where("source_id = 'shop'"), suggested)
    assert [r["raw_column"] for r in free.collect()] == [c for c in sources["shop"] if c not in {v[0] for v in claimed(sources["shop"]).values()}]


def test_normalize(spark):
    df = spark.createDataFrame([("  Invoice -Date ($) ",)], "c string")
    assert df.select(mapping.normalize_name(F.col("c"))).first()[0] == "invoice_date_"
