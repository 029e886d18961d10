"""Articles with inner containers keep all their text."""

import pytest

from tracelake.llm import html_text

LONG = ("w" * 70 + ", ") * 5 + "end" * 10


@pytest.mark.parametrize("n", [1, 6, 10, 40])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_nested_containers(tag, n):
    paragraphs = [f"{i} {LONG}" for i in range(n)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<body><nav>menu</nav><{tag}><h1>T</h1><div>{body}</div><section><h2>S</h2><p>last {LONG}</p></section><aside>ad</aside></{tag}><footer>foot</footer></body>"
    assert html_text.main_text(page) == " ".join(["T", *paragraphs, "S", f"last {LONG}"])
