import numpy as np
import pytest

import corpus_pipeline as C
from tallyloom.llm import queries

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def test_literal_added_tokens_get_their_id(spark, tmp_path):
    texts = ["<|endoftext|> it's", "plain words", "a <|endoftext|><|endoftext|>  b\n<|endoftext|", "x" * 10 + " word" * 3000 + "<|endoftext|>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    coder = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert want[0] == [50256, 340, 338, 0]
    got = {}
    for x in sorted(C.packed(spark, df, str(tmp_path)).collect(), key=lambda x: (x.doc_id, x.start)):
        got.setdefault(x.doc_id, []).extend(np.frombuffer(bytes(x.ids), "<u4").tolist())
    assert got == want
    lengths = {x.doc_id: x.doc_tokens for x in queries.op2_packing(spark, str(tmp_path)).collect()}
    assert lengths == {i: len(ids) for i, ids in want.items()}
