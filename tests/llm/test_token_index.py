"""Reading token files goes by the hash index."""

import numpy as np
import pytest

from folio.llm import tokenfile


def rewrite(path, change):
    raw = bytearray(path.read_bytes())
    index = tokenfile.ShardIndex(bytes(raw))
    at = len(raw) - 8 * (2 * index.n_docs + 1) - 8 * index.n_keys
    ranks = index.ranks.copy()
    change(ranks)
    raw[at : at + 8 * len(ranks)] = ranks.tobytes()
    path.write_bytes(bytes(raw))


@pytest.mark.parametrize("wrong", ["none", "swapped", "next", "far"])
def test_rows_come_from_the_index(spark, tmp_path, wrong):
    rows = [(i // 2, f"text {i} " * (i % 5)) for i in range(40)] + [(None, "x"), (None, None)]
    uri = tmp_path.as_uri() + "/t"
    tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), uri, shards=1)

    def change(ranks):
        if wrong == "swapped":
            ranks[[0, 1]] = ranks[[1, 0]]
        elif wrong == "next":
            ranks[3] += np.uint64(1)
        elif wrong == "far":
            ranks[3] = 10_000

    rewrite(next((tmp_path / "t").glob("*.idx")), change)
    read = tokenfile.read_token_files(spark, uri, block=7)
    if wrong == "none":
        assert read.count() == 42 and read.where("found").count() == 40
    else:
        with pytest.raises(Exception, match="does not lead"):
            read.collect()
