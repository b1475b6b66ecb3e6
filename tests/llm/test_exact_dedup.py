import hashlib
from collections import defaultdict

from fairgate.llm.exact_dedup import exact_dedup

from .fixtures import docs, edge_rows, empty


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        text = text or ""
        sha = hashlib.sha256("".join(c for c in text if c not in " \t\n\v\f\r").encode()).hexdigest()
        groups[sha].append((-len(text), i is None, i if i is not None else 0, i))
    out = []
    for sha, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, sha) for m in members]
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


def test_edges_and_clashing_columns(spark):
    rows = edge_rows()
    assert result(exact_dedup(docs(spark, rows, extra=True))) == brute(rows)


def test_one_text_in_a_third_of_all_rows_and_a_crowded_filter(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 400}", "en", "a") for i in range(900)]
    assert result(exact_dedup(docs(spark, rows))) == brute(rows)
    # a filter of the least size lets many rows through, the result stays
    assert result(exact_dedup(docs(spark, rows), cells_per_row=1)) == brute(rows)


def test_empty_table(spark):
    df = exact_dedup(empty(spark))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0
