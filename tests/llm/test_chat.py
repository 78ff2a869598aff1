import random

from quillgraph.llm import chat


def test_round_trip_of_random_fields():
    rng = random.Random(3)
    parts = ["<", "|", "\\", "\n", "n", "<|", "<|im_end|>", "<|im_start|>", "assistant", ">", "x", "", "é", "\\n", "<\\|"]
    for _ in range(4000):
        role = "".join(rng.choices(parts, k=rng.randint(0, 4)))
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        rendered = chat.round_trip(role, text)
        assert chat.parse(rendered)[0][:2] == (role, text)
        both = rendered + chat.round_trip(text, role)
        assert [x[:2] for x in chat.parse(both)] == [(role, text), (text, role)]


def test_text_without_conflicts_stays():
    assert chat.round_trip("user", "a < b | c") == "<|im_start|>user\na < b | c<|im_end|>\n"
