"""What a Python worker holds after a group or task counts as its executor's memory."""

import psutil
import pyarrow as pa

from tidepanel.llm import common, substrings


def held_after(call):
    start, kept = psutil.Process().memory_info().rss, []

    def run(*_):
        many = [bytes(2000) for _ in range(60_000)]
        kept.append(bytes(2000))  # above the others, so that these are not given back by themselves
        del many
        return pa.table({})

    call(run)
    return (psutil.Process().memory_info().rss - start) >> 20


def test_freed_memory_goes_back_after_a_group_and_a_task():
    assert held_after(lambda run: common.releasing_groups(run)(None, None)) < 40
    assert held_after(lambda run: list(common.releasing(lambda batches: [run()])([]))) < 40


def test_passages_are_removed_in_buckets_of_four_megabytes(spark, monkeypatch):
    asked = []

    def counted(docs, **given):
        asked.append(given.get("bytes_each", 8 << 20))
        return common.bucket_count(docs, **given)

    monkeypatch.setattr(substrings, "bucket_count", counted)
    substrings.remove_repeats(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert asked and max(asked) <= 4 << 20
