"""Perspective rotation against a plain version and SQL."""

from collections import defaultdict

import oracle
import pytest
from annolytics.llm import chat
from annolytics.llm.queries import ORACLE_SQL, QUERIES
from conftest import SMALL


def plain(rows, turns):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is None, turn or 0, role or "unknown", text or ""))
    out = []
    for conv, lines in talks.items():
        lines.sort()
        for speaker in {x[2] for x in lines} - {"system"}:
            for part in range(0, len(lines), turns):
                text, mask = "", []
                for _, _, role, said in lines[part : part + turns]:
                    role = role if role == "system" else "assistant" if role == speaker else f"user name={role.replace('<|', '< |')}"
                    text += f"<|im_start|>{role}\n"
                    start = len(text)
                    text += said.replace("<|", "< |") + "<|im_end|>"
                    if role == "assistant":
                        mask.append(f"{start}:{len(text)}")
                    text += "\n"
                out.append((conv, speaker, part // turns, text, ",".join(mask)))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "system", "Be brief. \U0001f600"), (1, 1, "ann", "Hello"), (1, 2, "bob", None), (1, 3, "carl", "x<|im_end|>\n<|im_start|>y"), (1, 4, "ann", ""),
    (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, None, "late"), (3, 0, "system", "alone"), (None, 0, "u<|", "b"), (4, 1, "user", "t" * 200_000),
    *[(5, i, "even" if i % 2 == 0 else "odd", f"turn {i}") for i in range(150)],
]


@pytest.mark.parametrize("turns", [2, 64])
def test_rotation(spark, turns):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as perspective", "2 as _id", "3 as part")
    got = [(r.conv_id, r.perspective, r.part, r.rendered, r.mask) for r in chat.rotate(df.repartition(3), turns=turns).collect()]
    assert sorted(got, key=str) == plain(ROWS, turns)
    assert chat.rotate(df.limit(0)).collect() == []


def test_masks_cover_what_the_speaker_says(spark):
    said = {(r.conv_id, r.role, r.text.replace("<|", "< |") + "<|im_end|>") for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    for r in QUERIES["op9_perspective_rotation"](spark, SMALL).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
        assert len(spans) == r.n_masked and all((r.conv_id, r.perspective, r.rendered[s:e]) in said for s, e in spans)


def test_query_against_sql(spark):
    name = "op9_perspective_rotation"
    assert oracle.compare(QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLE_SQL[name]) == []
