"""What a Python worker still holds when its task is over."""

import subprocess
import sys
from pathlib import Path

import pytest

WORK = """
import random
import re

import numpy as np
import pyarrow as pa

from winnow.llm import kneser_ney, near


def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024


def batches(seed, n):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(20_000)]
    for _ in range(n):
        texts = [" ".join(r.choices(known, k=500)) for _ in range(1000)]
        columns = {"rid": range(1000), "doc_id": range(1000), "text": texts, "lang": ["en"] * 1000, "fold": [1] * 1000}
        yield pa.RecordBatch.from_pydict(columns)


numbers = pa.list_(pa.int32())
signed = [("rid", pa.int64()), ("words_a", pa.int64()), ("words_b", pa.int64()), ("signature", numbers), ("shingles", numbers)]
run = {
    "signed": lambda: near._signed(80, pa.schema(signed)),
    "counted": lambda: kneser_ney._counted(5, pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])),
}[NAME]
sum(x.num_rows for x in run()(batches(1, 0)))
before = held()
rows = sum(x.num_rows for x in run()(batches(2, 4)))
print(rows, held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
@pytest.mark.parametrize("name", ["signed", "counted"])
def test_a_task_gives_back_the_memory_that_it_freed(name):
    root = Path(__file__).parents[2]
    said = subprocess.run([sys.executable, "-c", f"NAME = {name!r}\n{WORK}"], cwd=root, capture_output=True, text=True, check=True)
    rows, more = said.stdout.split()
    assert int(rows) > 0
    assert float(more) < 70, f"{more} MB are still held"
