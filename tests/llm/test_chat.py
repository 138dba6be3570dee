import hashlib
import random

from hypothesis import given, strategies as st

import public_tokenizers
from pyspark.sql import functions as F

from terrane.llm import chat as C

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["<", "[", "|", "\\", "s>", "/", "INST]", "<|end|>", "<|turn|>user<|text|>", "</s>[INST] ok [/INST]", "é", "日本", "\n", " ", "<|endoftext|>", "\U0001f600"]


@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    e = C.escape(text)
    assert C.unescape(e) == text
    assert not any(m in e for m in (*C.MARKS, "</s>", "[INST]", "[/INST]", "<|endoftext|>"))


def test_whole_conversations_come_back(spark):
    r = random.Random(1)
    rows = []
    for conv in range(6):
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system"]), "".join(r.choice(PARTS) for _ in range(r.randrange(0, 8)))))
    rows += [(6, 0, "assistant", None), (6, 0, "assistant", None), (6, None, None, "first"), (None, 1, "assistant", "no conversation"),
             (7, 0, "assistant", "long " * 90_000), (7, 1, "user", "then"), (7, 2, "assistant", "again " * 60_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("part"), F.lit(2).alias("ids")).repartition(3)
    written = C.format_conversations(df, VOCABULARY)
    assert written.where("conv_id = 7").count() > 1
    got = {r.conv_id: r for r in C.conversation_digests(written, VOCABULARY).collect()}
    convs = {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_parts_encode_as_the_whole(spark):
    turns = [("user", "Hello  there"), ("assistant", " yes\n\nno "), ("assistant", "")]
    tok = C.tokenizer(VOCABULARY)
    whole, spans = C.render(turns)
    parts = [C.render([t])[0] for t in turns]
    assert tok.encode(whole, add_special_tokens=False).ids == [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids]
    assert C.parse(whole) == turns and [whole[s:e] for s, e in spans] == [" yes\n\nno ", ""]


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(C.format_conversations(df, VOCABULARY), VOCABULARY).count() == 0
