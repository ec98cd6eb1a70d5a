import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from hearthline.llm.token_store import EliasFano, Reader, new_folder, read, write  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [5] * 1300, list(range(3000)), sorted(random.Random(1).randrange(10**9) for _ in range(2500)), [0] * 600 + [10**7]])
def test_elias_fano(values):
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert [code.select(i) for i in range(len(values))] == values
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 1000:
        assert len(code.to_bytes()) * 8 < len(values) * (3.5 + max(0, np.log2((values[-1] + 1) / len(values)))) + 2000


def test_written_and_read_back(spark, docs_of):
    rng = random.Random(2)
    texts = [None, "", "x " * 3000, "né日本", "same", "same"] + [" ".join(rng.choice(["go", "stop", "later"]) for _ in range(rng.randint(0, 50))) for _ in range(60)]
    ids = [3, None, -9, 5, 7, 7] + rng.sample(range(100, 10**9), 60)
    docs = docs_of(texts, ids).repartition(3)
    shards = write(docs, PATH, new_folder(spark), end_id=1)
    rows = read(spark, shards, keep_ids=True, span=64).collect()
    library = tokenizers.Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, text in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        part = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
        start += len(part)
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.start)] == want
    first = Reader(shards[0].uri)
    assert [(first.doc_id(i), first.document(i).tolist()) for i in range(first.n_docs)] == [(w[0], w[4]) for w in want[: first.n_docs]]
    assert read(spark, write(docs_of([]), PATH, new_folder(spark))).count() == 0
