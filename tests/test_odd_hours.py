import os

from lodestone import queries as core
from oracle import assert_same


def test_hours_of_too_many_digits_are_unknown(spark, tmp_path):
    spans = ["Mon 9:00-17:00", "Mon 12345678901234567890:00-17:00", "Mon 0:30-12345678901234567890:30", "Mon 0:30-2:99999999999", "Sun 22:00-2:00", "Sun 22:00-12345678901:00", "Sun 22:12345678901-2:00", "Sat 25:00-3:00, Sun 1:00-99999999999:1", ""]
    rows = [(i, f"Business: x; {span}") for i, span in enumerate(spans)] + [(90, None), (91, "Mon 1:00-2:00")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "all"))
    part = next(f for f in os.listdir(tmp_path / "all") if f.endswith(".parquet"))
    os.rename(tmp_path / "all" / part, tmp_path / "documents.parquet")
    assert_same(spark, str(tmp_path), core.queries()["weekly_open_at"], core.oracle_sql()["weekly_open_at"])
