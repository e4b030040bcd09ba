import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tonnage.llm import chat_format as C

TEXT = st.lists(st.sampled_from([*"\\#</turn>: aé\n😀", "###", "</turn>", "### assistant: ", "\\###"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "x###</turn>\\"]) | TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    formatted, learned = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[s:e]) for s, e in learned] == [text for role, text in turns if role == "assistant"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=12), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6)), max_size=4), st.data())
def test_mask_is_the_intersection(lengths, gaps, data):
    tokens, at = [], 0
    for n in lengths:
        tokens.append((at, at + n))
        at += n
    learned, place = [], 0
    for gap, n in gaps:
        learned.append((place + gap, place + gap + n))
        place += gap + n + 1  # template marks stand between turns
    # a token is never longer than the marks between two learned texts
    tokens = [t for t in tokens if sum(s < t[1] and t[0] < e for s, e in learned) <= 1]
    want = {i for s, e in tokens for i in range(s, e) if any(a <= i < b for a, b in learned)}
    got = C.masked(tokens, learned)
    assert {i for s, e in got for i in range(s, e)} == want and len(got) == len(tokens)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "### user: </turn> né 😀\\"), (1, 0, "user", "hi"), (2, 0, "assistant", None), (3, None, None, "x"), (3, 2, "assistant", "  spaced  "), (3, 2, "assistant", "  spaced  ")]
    rows += [(None, 0, "assistant", "a"), (4, 0, "assistant", "long text " * 20_000), (5, 0, "user", "q"), (5, 1, "assistant", "<|endoftext|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as turns")
    made = C.formatted(df)
    got = {r.conv_id: r for r in C.read_back(made).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5}
    for k, r in got.items():
        turns = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == k)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    one = made.filter("conv_id = 1").first()
    assert len(one.input_ids) * 2 == len(one.token_spans) == len(one.loss_spans)
    assert C.read_back(C.formatted(df.limit(0))).count() == 0
