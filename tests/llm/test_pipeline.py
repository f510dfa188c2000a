"""The pipeline against brute force on its own input, stage by stage."""

import corpus_pipeline
from quirelake.llm import pii_semicrf, toxicity_fm
from quirelake.llm.queries import tokenizer_path
from tests.llm.test_contracts import brute_components, brute_contamination, pairs, shingle_sets
from tokenizers import Tokenizer


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, small)
        if name != "tokens":
            assert made.schema.simpleString() == docs.schema.simpleString()
        made = made.cache()
        before, after = dict(pairs(docs)), dict(pairs(made)) if name != "tokens" else {}
        if name == "toxicity":
            machine = toxicity_fm.fit(docs, labels)
            assert set(after) == {i for i, t in before.items() if machine.scores([t.encode()])[0] < 0.5}
        elif name == "near_duplicates":
            assert set(after) == {i for i, c in brute_components(shingle_sets(docs, 5)).items() if i == c}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute_contamination(before.items(), benchmark) if not r[-1]}
        elif name == "personal_data":
            field = pii_semicrf.trained()
            assert after == {i: pii_semicrf.masked(t, pii_semicrf.find(t, field)[1]) for i, t in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in made.collect())
        else:
            library = Tokenizer.from_file(tokenizer_path())
            library.no_truncation()
            for r in made.collect():
                ids = library.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids
                assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
            assert made.select("doc_id").distinct().count() == made.count() == len(before)
        docs = made
    assert corpus_pipeline.run(spark, small).count() == docs.count()
