import hashlib
import random

import numpy as np
from corpusloom.llm import chat_format as C
from corpusloom.llm.packing import tokenizer_path

ROWS = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["", "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "&lt;|end|>", "&amp;lt;", "&", "[INST]&lsqb;", "naïve 日本語 🙂", "a\r\n\n<|end|>", "<<|turn|>", "&amp;amp;amp;", "x" * 3000, "\x00\x1f "]


def test_round_trip():
    rnd = random.Random(1)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "system", "odd\nrole", "back\\slash\\n", "<|end|>", ""]), "".join(rnd.choices(NASTY, k=rnd.randint(0, 3)))) for _ in range(rnd.randint(0, 6))]
        formatted, ids, mask, spans = C.format_chats([turns], tokenizer_path(C.VOCABULARY))[0]
        assert C.parse(formatted) == turns
        under = "".join(C.unescape(formatted[a:b]) for a, b in spans)
        assert under == "".join(t for r, t in turns if r == "assistant")
        assert len(ids) == len(mask)


def test_token_mask_against_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        cuts = sorted(rnd.sample(range(60), 12))
        offsets = np.array(list(zip(cuts, cuts[1:], strict=False)))
        ends = sorted(rnd.sample(range(0, 64, 4), 4))
        spans = np.array([(ends[0], ends[1]), (ends[2] + 3, max(ends[2] + 3, ends[3]))])
        mask, covered = C.token_mask(offsets, spans)
        first = [next((s for s in spans if s[1] > a), None) for a, b in offsets]
        assert mask.tolist() == [s is not None and max(a, s[0]) < min(b, s[1]) for (a, b), s in zip(offsets, first, strict=True)]
        assert all(any(s[0] <= a < b <= s[1] for s in spans) for a, b in covered)


def test_conversations(spark):
    rows = [(1, 0, "user", NASTY[1], "c"), (1, 1, "assistant", NASTY[2], "c"), (1, 1, "assistant", NASTY[2], "c"), (1, None, "system", None, "c"), (2, 0, None, "t", "c"), (None, 3, "assistant", "x" * 200_000, "c"), (2**60 + 1, 0, "user", "", "c")]
    got = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, ROWS)).collect()}
    assert C.parse(got[1].formatted) == [("system", ""), ("user", NASTY[1]), ("assistant", NASTY[2]), ("assistant", NASTY[2])]
    assert C.parse(got[2].formatted) == [("", "t")] and C.parse(got[2**60 + 1].formatted) == [("user", "")]
    assert len(got) == 4 and sum(b - a for a, b in got[None].loss_spans) == 200_000
    assert C.format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_query_adds_the_hard_conversation(spark, tmp_path):
    spark.createDataFrame([(5, 0, "user", "hi", "")], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in C.op8_chat_formatting(spark, str(tmp_path)).collect()}
    hard = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and got[-1].loss_chars == len(hard)
    assert got[5].loss_chars == 0 and got[5].n_turns == 1
