import subprocess
import sys
from pathlib import Path

import pytest

# Python workers outlive their tasks: what a task keeps adds to the memory of every later one on the same executor.
PROGRAM = """
import random, re, sys
import pyarrow as pa, pyspark

class Task:
    get = classmethod(lambda cls: cls)
    partitionId = classmethod(lambda cls: 0)

pyspark.TaskContext = Task
from tallystar.llm import exact_dedup, quality, suffix_tree

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(50_000)]
    for first in range(0, 20_000, 10_000):
        texts = [" ".join(draw.choices(words, k=300)) for _ in range(10_000)]
        yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(first, first + 10_000))], ["c0", "c1"])
        del texts

make = {"local": lambda: exact_dedup._local(0, 1, exact_dedup.sha256_hex), "count": lambda: quality._count(1 << 16, frozenset()),
        "words": lambda: suffix_tree._words}[sys.argv[1]]
run = make()
before = held()
assert sum(batch.num_rows for batch in run(batches()))
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux' account of memory")
@pytest.mark.parametrize("step", ["local", "count", "words"])
def test_tasks_give_their_memory_back(step):
    out = subprocess.run([sys.executable, "-c", PROGRAM, step], capture_output=True, text=True, timeout=120,
                         cwd=Path(__file__).parents[2])
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 95
