"""The staff flow on hand-made hits: catalogue answers, retrieval depth, wording, refusals."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import answers as A
from larder.plans.answer_queries import STAFF_EXAMPLES
from larder.session import AS_OF
from larder.sources.views import RetailModel

MEAL, STORE = len(STAFF_EXAMPLES) - 1, len(STAFF_EXAMPLES)


@pytest.fixture(scope="module")
def parts(spark):
    m = RetailModel(spark, SF_SMALL)
    texts = STAFF_EXAMPLES + ["Which store is near downtown and is it open now?"]
    q = spark.createDataFrame([(str(i), i, 3, t) for i, t in enumerate(texts)], "query_id string, conv_id long, turn int, text string")
    turns = spark.createDataFrame([(i, t, "user" if t % 2 else "assistant", f"said {t}", 1000 + 60 * t) for i in range(len(texts)) for t in (1, 2, 3)],
                                  "conv_id long, turn int, role string, text string, ts_s long")
    ids = [str(i) for i in range(len(texts))]
    ph = spark.createDataFrame([(i, r, f"SKU{r}", f"product{r}", float(r), "each", "MEAL", False, None) for i in ids for r in range(1, 13)],
                               "query_id string, rank int, sku string, name string, price double, unit string, category string, is_organic boolean, brand string")
    dh = spark.createDataFrame([(i, r, f"deal{r}", f"product{r}", "BOGO" if r < 6 else "late", 0.0, f"SKU{7 - r}") for i in ids for r in range(1, 7)],
                               "query_id string, rank int, title string, product_name string, deal_type string, discount_percent double, product_sku string")
    sh = spark.createDataFrame([(i, r, f"store{r}", "1 A St", "X", "FL", "33800", "(863)") for i in ids for r in range(1, 6)],
                               "query_id string, rank int, name string, address string, city string, state string, zip_code string, phone string")
    return m, q, (turns, ph, dh, sh, m.products, m.categories, m.deals)


def test_staff_flow(spark, parts):
    m, q, rest = parts
    got = {int(r.query_id): r for r in A.staff_chat_batch(q, *rest, as_of=AS_OF, staff_role="MANAGER").collect()}
    assert len(got) == q.count()
    known = {r.question_id: r for r in A.staff_answer(q.select(F.col("query_id").alias("question_id"), "text"), m.products, m.categories,
                                                     m.deals, as_of=AS_OF).collect()}
    for i in range(MEAL):  # one example of each action
        r = got[i]
        assert (r.model, r.response, r.products, r.message_count, r.latency_ms, r.prompt) == ("db_direct", known[str(i)].answer, [], 0, 0.0, None)
        assert r.response and r.action == known[str(i)].action != "rag"
    for i, stores in ((MEAL, 0), (STORE, 3)):
        r = got[i]
        assert (r.action, r.model, r.message_count) == ("rag", "template", 4) and r.latency_ms is None
        assert r.prompt.count("- product") == 8 and r.prompt.count("- deal") == 5 and r.prompt.count("- store") == stores
        assert r.prompt.startswith("Based on the following product data:") and r.prompt.endswith(" You are speaking to a store manager.")
        # the sixth deal lies behind the plan's five: SKU1 keeps none
        assert [(p.sku, p.deal_type) for p in r.products] == [("SKU1", None)] + [(f"SKU{k}", "BOGO") for k in range(2, 6)]
        assert r.response == "Here is what I found:\n" + "\n".join(x for x in r.prompt.split("\n") if x.startswith("- product"))[:10 ** 6].split("\n- product4")[0]


def test_staff_roles(spark, parts):
    _, q, rest = parts
    for role in (None, "", "customer"):
        with pytest.raises(PermissionError):
            A.staff_chat_batch(q, *rest, as_of=AS_OF, staff_role=role)
    one = A.staff_chat_batch(q.filter(F.col("query_id") == str(MEAL)), *rest, as_of=AS_OF, staff_role="associate").first()
    assert one.prompt.endswith("Staff question (associate): " + STAFF_EXAMPLES[MEAL])
