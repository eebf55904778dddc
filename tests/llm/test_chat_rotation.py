"""Rotated dialogues against a direct rendering."""

from girder.llm import chat_rotation


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, 300, "bob", "é late"), (2, 0, "system", "alone"), (None, 0, "x", "y"), (3, None, None, "who"), (3, None, None, "who")]
    turns = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, mask string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat_rotation.rotate(turns).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        for who in {r[2] or "" for r in rows if r[0] == conv} - {"system"}:
            for part in {-1 if r[1] is None else r[1] // 256 for r in rows if r[0] == conv}:
                said = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv and (-1 if t is None else t // 256) == part)
                text, mask = "", []
                for _, role, body in said:
                    text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user {role}|>\n"
                    start = len(text)
                    text += body.replace("<|", "<\\|") + "<|end|>\n"
                    mask += [f"{start}:{len(text)}"] if role == who else []
                want[conv, who, part] = (text, " ".join(mask), len(said))
    assert {k: (r.text, r["mask"], r.n_turns) for k, r in got.items()} == want
    assert chat_rotation.rotate(turns.limit(0)).count() == 0
