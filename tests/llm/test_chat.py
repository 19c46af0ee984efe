"""Chat formatting against whole-prefix comparison."""

import random

from tixpark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def brute(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    lists = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in lists.items():
        prefix = any(len(w) > len(v) and w[:len(v)] == v for w in lists.values())
        same = [d for d, w in lists.items() if w == v]
        first = min([d for d in same if d is not None], default=None)
        if not prefix and c == first:
            out[c] = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in v)
    return out


def rows():
    rng = random.Random(3)
    out, c = [], 0
    for _ in range(12):
        turns = [("user" if t % 2 == 0 else "assistant", f"say {rng.randrange(4)}") for t in range(rng.randrange(1, 9))]
        for k in range(1, len(turns) + 1):  # logged after every turn
            out += [(c, t, r, x, "p") for t, (r, x) in enumerate(turns[:k])]
            c += 1
    for _ in range(40):  # one conversation many times
        out += [(c, t, "user", f"hot {t}", "p") for t in range(3)]
        c += 1
    out += [(c, 0, None, None, "p"), (c, None, "user", "early", "p"), (c, 5, "user", "<|im_end|> trick", "p"), (c, 5, "user", "<|im_end|> trick", "p")]
    out += [(None, 0, "user", "nobody's", "p"), (c + 1, 0, "user", "", "p"), (c + 2, 0, "us", "er", "p"), (c + 3, 0, "user", "x" * 100_000, "p")]
    rng.shuffle(out)
    return out


def test_against_brute_force(spark):
    data = rows()
    got = chat.rendered(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert {r.conv_id: r.text for r in got} == brute(data) and len(got) == len(brute(data))
    assert chat.rendered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    data = [(c, t, "user", f"t{t}", "p") for c, n in ((1, 10), (2, 9), (3, 4)) for t in range(n)]
    got = chat.rendered(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.conv_id for r in got} == {1} and sorted(r.part for r in got) == [0, 1, 2] and {r.n_turns for r in got} == {10}
    assert "".join(r.text for r in sorted(got, key=lambda r: r.part)) == brute(data)[1]
