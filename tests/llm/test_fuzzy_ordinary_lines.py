import random
import string
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from codestrata.llm import op6_fuzzy_lines as op6


def test_one_changed_character_in_lines_of_ordinary_length(spark):
    draw = random.Random(4)
    rows = []
    for i, n in enumerate((49, 55, 60, 70, 80, 98)):
        line = "".join(draw.choice(string.ascii_lowercase + " ") for _ in range(n - 1)) + "z"
        copy = line[: n // 2] + "#" + line[n // 2 + 1 :]
        assert op6.line_similarity(line, copy) >= op6.THRESHOLD
        rows += [(2 * i, line), (2 * i + 1, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.lines) for r in op6.repeated_lines(docs).collect()} == {i: [0] for i in range(1, len(rows), 2)}
