"""A batch in slices searches once for all its open questions."""

import json

from passagework.operators.chunking import index_documents
from passagework.operators.embedding import HashedEmbedder
from passagework.plans import batch
from passagework.plans.batch import resume_batch


def echo():
    return lambda prompts: [p.split("<|im_start|>user\n")[1].split("<|im_end|>")[0] for p in prompts]


def test_slices_share_one_search(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "apples and pears"), (2, "bonds")], "doc_id long, text string")
    index = index_documents(docs, HashedEmbedder(8))
    asked = tmp_path / "q.jsonl"
    searched, search = [], batch.retrieve

    def counting(queries, *args, **options):
        searched.append(queries.count())
        return search(queries, *args, **options)

    monkeypatch.setattr(batch, "retrieve", counting)
    models = {"multitask": echo, "sentiment": echo}
    answers = str(tmp_path / "answers")

    def run(questions):
        asked.write_text("\n".join(json.dumps({"query": q}) for q in questions))
        resume_batch(spark, str(asked), answers, index, models, slices=3, embedder=HashedEmbedder(8))
        return [json.loads(r.value) for r in spark.read.text(answers).collect()]

    first = [f"apples {i}" for i in range(9)]
    got = run(first)
    assert searched == [9]
    assert sorted(r["answer"] for r in got) == first and {r["rag_status"] for r in got} <= {"ok", "low_confidence"}
    assert len(run([*first, "bonds 1", "bonds 2"])) == 11 and searched == [9, 2]
    assert len(run(first)) == 9 and searched == [9, 2]
