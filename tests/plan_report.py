"""Print the physical-plan facts that matter at scale for selected queries
(scan schema and pushed filters, join strategies, exchanges, partial
aggregates, window group limits, Python stages). Writes PLANS.md.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

KEEP = re.compile(r"^\(\d+\) (Scan parquet|BroadcastHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|CartesianProduct|"
                  r"ShuffledHashJoin|Exchange|HashAggregate|WindowGroupLimit|Window|MapInPandas|ArrowEvalPython|"
                  r"TakeOrderedAndProject|BroadcastExchange|Sort)|^(ReadSchema|PushedFilters|Arguments|Keys|Functions)")

QUERIES = ["category_stats", "count_deals", "revenue_impact", "deals_by_category", "cart_state", "first_active_deal",
           "products_filtered_page", "latency_percentiles", "vector_top_k", "classify_documents", "dq_foreign_keys"]


def main() -> None:
    from larder.session import ensure_checkpoint_dir, get_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    ensure_checkpoint_dir(spark)
    qs = E.queries()
    out = ["# PLANS", "", f"Physical plans (AQE initial plan, `explain('formatted')`) at {sf}, filtered to the",
           "lines that decide scale behaviour. Regenerate with `python tests/plan_report.py`.", ""]
    for n in QUERIES:
        buf = io.StringIO()
        with redirect_stdout(buf):
            qs[n](spark, sf).explain("formatted")
        lines = [ln for ln in buf.getvalue().splitlines() if KEEP.search(ln)]
        out += [f"## {n}", "", "```"] + [ln[:220] for ln in lines] + ["```", ""]
    with open(__file__.rsplit("/tests/", 1)[0] + "/PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
