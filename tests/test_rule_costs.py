"""Patterns of the rules pass over characters that cannot begin a match, and give what the plain ones do."""

import random
import re
import timeit

from inkspan.functions.rules import groups, repairs, validators


def test_plain_characters_are_passed_over():
    text = "plain words " * 20000
    seconds = lambda run: min(timeit.repeat(run, number=1, repeat=5))
    bare = seconds(lambda: re.findall(r"[%\\{}&\n]", text))
    assert seconds(lambda: list(groups.tokens(text))) < 6 * bare
    assert seconds(lambda: repairs._brace_marks(text)) < 6 * bare


def test_marks_and_surplus_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["{", "}", "\\", "%", "a", "\n"]) for _ in range(rng.randint(0, 20)))
        part = validators.live(text)
        plain = re.match(r"((?:[^%\\]|\\.)*)%", text, re.S)
        assert part == (plain.group(1) if plain else text)
        assert repairs._surplus(text) == len(re.findall(r"(?<!\\)\{", part)) - len(re.findall(r"(?<!\\)\}", part))
        blanked = re.sub(r"(?<!\\)%[^\n]*", lambda m: " " * len(m.group()), text)
        assert repairs._brace_marks(text) == [(m.start(), m.group()) for m in re.finditer(r"(?<!\\)[{}]", blanked)]
