"""The registered searches ask every row as a question, not some of them."""

import numpy as np
import pytest

from lexmill.functions import constants as K
from lexmill.plans.catalog import ORACLE, QUERIES

N = 30


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Thirty vectors with a document and a conversation each; of ids 1 to 30 only 20 is divisible by 20."""
    at, rng = tmp_path_factory.mktemp("whole") / "sf", np.random.default_rng(5)
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    ids = range(1, N + 1)
    unit = lambda: (lambda x: (x / np.linalg.norm(x)).tolist())(rng.normal(size=64))
    save("embeddings", [(i, unit(), i % 10) for i in ids], "vec_id long, embedding array<float>, label int")
    save("documents", [(i, f"paper {i % 4}, on la law {i}.\nNext part.", "en", "web", 30) for i in ids],
         "doc_id long, text string, lang string, source string, n_chars long")
    turns = [(i, t, role, f"{role} {i}") for i in ids for t, role in enumerate(("user", "assistant"))]
    save("conversations", turns, "conv_id long, turn long, role string, text string")
    return str(at)


#: What shows in a row that its question was asked, of those that hold all questions anyway.
ASKED = {"legal_gate": "best_score is not null", "verify_answers": "verified_refs <> ''", "reference_block": f"not contains(reference, '{K.NO_REFERENCE}')",
         "prompt_messages": "contains(content, '[본문]')"}


@pytest.mark.parametrize("name", [
    "search_general", "search_document", "search_hybrid", "hybrid_score", "topk_dense", "attach_text", "legal_gate", "prompt_hits", "sources",
    "valid_refs", "verify_answers", "reference_block", "prompt_messages", "stream_retrieve"])
def test_every_row_is_asked(spark, sf, name):
    found = {r["query_id"] for r in QUERIES[name](spark, sf).filter(ASKED.get(name, "true")).collect()}
    # an answer shows it only where its evidence backs one of its citations
    assert len(found - {20}) > 5 if name == "verify_answers" else found == set(range(1, N + 1))
    assert "% 20 = 0" not in ORACLE[name]


def test_answers_go_into_the_join_as_references(spark, sf):
    """With evidence for every answer the join sorts them; their whole texts need not go along."""
    node = QUERIES["verify_answers"](spark, sf)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    sent = {name.split("#")[0] for name in node.children().head().output().mkString(",").split(",")}
    assert sent == {"query_id", "answer_refs"}
