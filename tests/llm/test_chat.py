import random

from fieldshift.llm import chat

TURNS = "pair_id long, chosen boolean, turn long, role string, text string, prompt string"


def slow(rows):
    out = {}
    for pair in {r[0] for r in rows if r[0] is not None and r[1] is not None}:
        key = lambda r: tuple((x is not None, x) for x in r)
        a, b = (sorted((r[2:5] for r in rows if r[0] == pair and r[1] is side), key=key) for side in (True, False))
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        head = lambda t: f"<|{t[1] or ''}|>\n"
        body = lambda t: f"{t[2] or ''}\n<|end|>\n"
        show = lambda ts: "".join(head(t) + body(t) for t in ts)
        mask = lambda ts: ",".join(f"0*{len(head(t))},{int(t[1] == 'assistant')}*{len(body(t))}" for t in ts)
        out[pair] = (n, len(a), len(b), show(a[:n]), show(a[n:]), show(b[n:]), mask(a[n:]), mask(b[n:]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for pair in range(40):
        shared = [(t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé🙂", "", None])) for t in range(rng.randint(0, 5))]
        for side in (True, False):
            tail = [(5 + t, rng.choice(["user", "assistant"]), rng.choice(["x", "y"])) for t in range(rng.randint(0, 4))]
            rows += [(pair, side, *t, "clash") for t in shared + tail]
    rows += [(None, True, 0, "user", "x", ""), (50, None, 0, "user", "x", ""), (51, True, None, "user", "x", ""), (51, True, 0, "user", "long " * 5000, "")]
    rows += [(52, s, 0, "user", "again", "") for s in (True, True, False)]
    got = {r[0]: tuple(r)[1:] for r in chat.preferences(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == slow(rows)
    for _, (*_, chosen, rejected, chosen_mask, rejected_mask) in got.items():
        for text, mask in ((chosen, chosen_mask), (rejected, rejected_mask)):
            assert len(text) == sum(int(run.split("*")[1]) for run in mask.split(",") if run)


def test_empty_and_pairing(spark):
    assert chat.preferences(spark.createDataFrame([], TURNS)).count() == 0
    turns = spark.createDataFrame([(4, 0, "user", "q", 1), (5, 0, "user", "q", 1), (6, 0, "user", "r", 1), (None, 0, "user", "r", 1)], "conv_id long, turn long, role string, text string, pair_id int")
    got = {r.pair_id: (r.n_prefix, r.n_chosen, r.n_rejected) for r in chat.preferences(chat.neighbouring_pairs(turns)).collect()}
    assert got == {2: (1, 1, 1), 3: (0, 1, 0)}


def test_answered_pairs_share_all_but_the_last_turn(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "r"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (4, None, None, None), (None, 0, "user", "z")]
    turns = spark.createDataFrame([(*r, 7, "t") for r in rows], "conv_id long, turn long, role string, text string, pair_id int, last string")
    got = {r.pair_id: r for r in chat.formatted(chat.answered_pairs(turns)).collect()}
    assert {k: (r.n_prefix, r.n_chosen, r.n_rejected) for k, r in got.items()} == {1: (1, 2, 2), 2: (1, 3, 1), 4: (0, 1, 0)}
    assert got[1].chosen == "<|assistant|>\na\n<|end|>\n" and got[1].rejected == "<|assistant|>\nb\n<|end|>\n"
    assert got[2].rejected == "" and got[2].prompt == "<|user|>\nr\n<|end|>\n"
    assert chat.answered_pairs(turns.limit(0)).count() == 0


def test_query_equals_sql_and_has_prompts(spark):
    import duckdb

    from fieldshift.llm.queries import OP8_SQL, op8_chat

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    cursor = con.execute(OP8_SQL)
    names = [c[0] for c in cursor.description]
    rows = op8_chat(spark, "/root/testdata/sf0.01").select(names).collect()
    assert sorted(map(tuple, rows)) == sorted(cursor.fetchall())
    assert len(rows) == 100 and min(r.n_prefix for r in rows) >= 1 and all(r.prompt and r.chosen for r in rows)
