import random
import zlib

import numpy as np
import pytest

from boxframe.llm import quality_classifier, toxicity

from .helpers import docs, empty, prose, rows


def corpus(spark):
    r = random.Random(4)
    data, labels = [], []
    for i in range(360):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        text = prose(r, r.randint(10, 80))
        if toxic:
            text += " " + r.choice(["Dreadful", "horrid,"]) + " end"
        if bad:
            text = text.replace(" ", "### ")
        data.append((i, text, r.choice(["en", "fr"])))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    d, l = corpus(spark)
    model = module.train(d, l)
    truth = {x.doc_id: x[label] for x in l.collect()}
    got = module.score(d, model).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % module.FOLDS == module.HELD) for x in got)
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.9
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_defined_results(spark, module):
    d, l = corpus(spark)
    model = module.train(d, l)
    got = module.score(docs(spark), model).collect()
    assert len(got) == len(rows()) and all(x.score is not None for x in got)
    assert module.score(empty(spark), model).count() == 0
    none = module.train(d, l.where("doc_id < 0"))
    assert {x.predicted for x in module.score(d, none).collect()} <= {0, 1}


def test_labels_of_held_out_rows_are_not_read(spark):
    from pyspark.sql import functions as F

    d, l = corpus(spark)
    for module, label in ((quality_classifier, "quality"), (toxicity, "toxic")):
        held = F.crc32(F.col("doc_id").cast("string")) % module.FOLDS == module.HELD
        other = l.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (sorted((x.doc_id, x.score) for x in module.score(d, module.train(d, y)).collect()) for y in (l, other))
        assert a == b


def test_words_of_joined_texts():
    texts = [b"One, two", b"", b"\xc3\xa9t\xc3\xa9 TWO", b" "]
    ids, counts = toxicity.word_ids(*toxicity._joined(texts))
    assert counts.tolist() == [2, 0, 2, 0] and ids[0, 1] == ids[0, 3]
