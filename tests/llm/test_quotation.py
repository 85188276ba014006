"""Quotation linking on hand-made threads and against a direct reading of the rules."""

import random
import re

from llm import quotation


def test_threads(spark):
    rows = [
        ("c", 0, "user", "What is the best tea?\n\nI like green tea."),
        ("c", 1, "assistant", "> i like   GREEN tea.\nThen try sencha."),
        ("c", 2, "user", "> What is the best tea?\nSomebody said oolong."),
        ("c", 3, "assistant", ">> I like green tea.\n> Then try sencha.\n\nIt was good."),
        ("c", 4, "user", ">  >Then try sencha.\n>It was\n> good.\nThanks"),
        ("c", 5, "user", "> never said\nalone"),
        ("c", 6, "user", None),
        ("d", 0, "user", "> Then try sencha.\nother conversation"),
        (None, 1, "user", "> What is the best tea?"),
        ("c", None, None, "> What is the best tea?\nx"),
        ("e", 0, "user", "a\n> b"),
        ("e", 0, "user", "b"),
        ("e", 1, "user", "> b"),
        ("e", 1, "user", "> b"),
    ]
    messages = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id string, turn long, role string, text string, depth string")
    out = quotation.reply_order(messages).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert {t: got["c", t].reply_to for t in range(7)} == {0: None, 1: 0, 2: 0, 3: 1, 4: 3, 5: None, 6: None}
    assert got["d", 0].reply_to is None and got[None, 1].reply_to is None and got["c", None].reply_to is None and got["e", 1].reply_to == 0
    assert got["c", 4].depth == 3 and got["c", 4].reply_path == ".".join(f"{t:010d}" for t in (0, 1, 3, 4))
    assert got["c", 3].own_text == "It was good." and got["c", 6].own_text == "" and got["c", 1].formatted == "<|assistant|>\nThen try sencha."
    assert [r.turn for r in sorted((r for r in out if r.conv_id == "c" and r.turn is not None), key=lambda r: r.reply_path)] == [0, 1, 3, 4, 2, 5, 6]
    assert quotation.reply_order(messages.limit(0)).count() == 0


def brute(rows):
    """reply_to of each (conv, turn) by nested loops."""
    mark = re.compile(r"^\s*>(\s*>)*")
    norm = lambda s: re.sub(r"\s+", " ", s).lower().strip()
    own, quotes = {}, {}
    for c, t, text in rows:
        plain, runs = [], []
        for line in text.split("\n"):
            m = mark.match(line)
            level = m[0].count(">") if m else 0
            content = re.sub(mark.pattern + r"\s?", "", line)
            if level == 0:
                plain.append(content)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(content)
            else:
                runs.append((level, [content]))
        body = "\n".join(plain).strip()
        own[c, t] = {norm(x) for x in [body, *re.split(r"\n\s*\n", body), *body.split("\n")]}
        quotes[c, t] = [(lv, rank, norm(x)) for lv, lines in runs if lv for rank, xs in ((0, [" ".join(lines)]), (1, lines)) for x in xs if re.search(r"\w", x)]
    out = {}
    for (c, t), wanted in quotes.items():
        found = []
        for lv, rank, x in wanted:
            origin = min((u for (d, u), have in own.items() if d == c and x in have), default=None)
            if origin is not None and origin < t:
                found.append((lv, rank, -origin))
        out[c, t] = -min(found)[2] if found else None
    return out


def test_against_nested_loops(spark):
    r = random.Random(4)
    lines = [f"line {n} says something" for n in range(12)] + ["ok", "Yes  please", ""]
    rows = []
    for c in range(8):
        for t in range(r.randint(1, 14)):
            rows.append((c, t, "\n".join("> " * r.choice([0, 0, 0, 1, 1, 2, 3]) + r.choice(lines) for _ in range(r.randint(1, 6)))))
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): x for x in quotation.reply_order(messages).collect()}
    want = brute(rows)
    assert {k: v.reply_to for k, v in got.items()} == want
    for (c, t), x in got.items():
        chain = [t]
        while want[c, chain[0]] is not None:
            chain.insert(0, want[c, chain[0]])
        assert x.reply_path == ".".join(f"{u:010d}" for u in chain) and x.depth == len(chain) - 1


def test_order_of_long_and_negative_turns(spark):
    turns = [-(2**62), -11, -2, 0, 3, 9_999_999_999, 10_000_000_000, 1_700_000_000_001, 1_700_000_000_002, 2**63 - 1]
    rows = [("c", t, "user", f"message {n}") for n, t in enumerate(turns)] + [("d", 1_700_000_000_001, "user", "hello"), ("d", 1_700_000_000_002, "user", "> hello\nyes"), ("d", 1_700_000_000_003, "user", "> yes\nno")]
    out = quotation.reply_order(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted((r for r in out if r.conv_id == "c"), key=lambda r: r.reply_path)] == turns
    assert len({r.reply_path for r in out if r.conv_id == "c"}) == len(turns)
    thread = sorted((r for r in out if r.conv_id == "d"), key=lambda r: r.reply_path)
    assert [r.turn % 10 for r in thread] == [1, 2, 3] and [len(r.reply_path.split(".")) for r in thread] == [1, 2, 3]


def test_quoted_sentences(spark):
    rows = [
        (0, "Tea is old. It came from the east! \"Who drinks it?\" Many do.\n\nA heading\nover two lines"),
        (1, "> It came from\n> the east! \"Who drinks it?\"\nNobody knows."),
        (2, "> many do.\nA few.\nSome more of that\nwrapped text. The end"),
        (3, "> Some more of\n> that wrapped text.\nOh. 好。はい。"),
        (4, "> はい。\nright"),
        (5, "> came from the\nonly a part of a sentence"),
    ]
    messages = spark.createDataFrame([("c", t, "user", x) for t, x in rows], "conv_id string, turn long, role string, text string")
    assert {r.turn: r.reply_to for r in quotation.reply_order(messages).collect()} == {0: None, 1: 0, 2: 0, 3: 2, 4: 3, 5: None}
