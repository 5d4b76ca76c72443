from pyspark.sql import functions as F

from lodestone.llm import split_overlap as so

STEM = "a table near the window for {} people on a quiet evening in {}"


def texts(spark, copies):
    rows = [("eval", STEM.format(i, "may")) for i in range(12)] + [("train", STEM.format(i, "june")) for i in range(15)]
    return spark.createDataFrame(rows * copies, "role string, normal string")


def pairs(df):
    return sorted((r.eval_normal, r.train_normal, r.shared, r.n_eval, r.n_train) for r in so.overlapping_texts(df).collect())


def refuse(*_):
    raise AssertionError("joined on rare n-grams")


def test_repeated_texts_are_indexed_once(spark, monkeypatch):
    expected = pairs(texts(spark, 1))
    monkeypatch.setattr(so, "_by_rare_grams", refuse)
    monkeypatch.setattr(so, "INDEX_GRAMS", texts(spark, 1).where("role = 'eval'").agg(F.sum(F.length("normal"))).first()[0])
    monkeypatch.setattr(so, "INDEX_BLOCKS", 1)
    assert pairs(texts(spark, 5)) == expected and len(expected) == 12 * 15


def test_blocks_of_the_index_give_the_same_pairs(spark, monkeypatch):
    expected = pairs(texts(spark, 1))
    monkeypatch.setattr(so, "_by_rare_grams", refuse)
    monkeypatch.setattr(so, "INDEX_GRAMS", 200)
    assert pairs(texts(spark, 1)) == expected
