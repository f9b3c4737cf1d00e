import subprocess
import sys

import pytest

WORKER = """
import pyarrow as pa
from graincloak.llm.textcols import map_slices

class Frame:
    columns = ["text"]

    def mapInArrow(self, run, schema):
        self.run = run
        return self

pins = []

def each(rows, data, offsets):
    junk = [bytes(1000) for _ in range(50_000)]
    pins.append(bytes(1000))  # above the rest, so that the heap can't shrink by itself
    return [pa.array([len(junk)] * len(rows), pa.int64())]

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

run = map_slices(Frame(), "text", each, "n long").run
batch = pa.RecordBatch.from_arrays([pa.array(["some text"])], ["text"])
before = resident()
assert sum(len(x) for x in run([batch] * 3)) == 3
print(resident() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_its_memory_back():
    """A worker that lives on after a task of 50 MB holds little of it."""
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 15
