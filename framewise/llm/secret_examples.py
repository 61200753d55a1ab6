"""Training examples of the secret scan: secrets with their pattern hidden,
and harmless tokens that look a little like secrets.

A chain that learns from the patterns' own spans learns the patterns.  So each
tagged text also appears with the keyword replaced by another of its words,
the separator by another one and the value by random characters of another
alphabet and length: only shape and neighbours are left to carry the tag.
Plain texts appear with some words replaced by identifiers, paths, numbers,
dates and addresses made of their own words, which must stay untagged.

All choices come from the ``random.Random`` passed in.
"""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\W\d_]+")
HEXADECIMAL = "0123456789abcdef"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
MIXED = UPPER + UPPER.lower() + DIGITS
TRAILS = ("", "", "", " ", "\n", "\")", "'", ";", ". ")
ALPHABETS = (HEXADECIMAL, MIXED, MIXED, MIXED + "+/", MIXED + "_-", UPPER + DIGITS, UPPER.lower() + DIGITS, HEXADECIMAL.upper())
SEPARATORS = (" ", ": ", " = ", "=", ' := "', " '", '="', " -> ", "\n", ", ", " | ", " (", "_", "-", ". ", " '", "\": \"")


def made_secret(rng: random.Random) -> str:
    """Random characters that change between digits, capitals and small
    letters at least four times."""
    letters = rng.choice(ALPHABETS)
    while True:
        out = "".join(rng.choices(letters, k=rng.choice((16, 18, 20, 24, 28, 32, 36, 40, 48, 64))))
        kinds = [c.isdigit() + 2 * c.isupper() for c in out]
        if sum(x != y for x, y in zip(kinds, kinds[1:])) >= 4:
            return out


def hidden(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with every (start, value, end) rewritten, and where the new
    values lie.  ``start`` to ``value`` is keyword and separator;
    their place is now and then left empty."""
    own = WORDS.findall(text[:20_000])
    parts, marks, at, size = [], [], 0, 0
    for start, _, end in spans:
        if start < at:
            continue
        lead = rng.choice((0, 1, 1, 1)) * ((rng.choice(own) if own else "") + rng.choice(SEPARATORS))
        made, trail = made_secret(rng), rng.choice(TRAILS)
        parts += [text[at:start], lead, made, trail]
        size += start - at + len(lead)
        marks.append((size, size + len(made)))
        size += len(made) + len(trail)
        at = end
    return "".join([*parts, text[at:]]), marks


def _decoy(own: list[str], rng: random.Random) -> str:
    some = [rng.choice(own) for _ in range(rng.randint(2, 5))]
    number = lambda low, high: "".join(rng.choices(DIGITS, k=rng.randint(low, high)))
    return rng.choice((
        lambda: some[0].lower() + "".join(w.capitalize() for w in some[1:]),
        lambda: "".join(w.capitalize() for w in some) + rng.choice(("", number(1, 2))),
        lambda: "_".join(some).lower() + rng.choice(("", "_" + number(1, 4))),
        lambda: "_".join(some).upper(),
        lambda: "-".join(some) + rng.choice(("", "-" + number(1, 4))),
        lambda: "/".join(some) + rng.choice(("", "/" + number(1, 6))),
        lambda: number(5, 20),
        lambda: f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}",
        lambda: f"+{number(2, 2)}-{number(3, 3)}-{number(6, 8)}",
        lambda: some[0] + number(1, 4),
        lambda: f"https://www.{some[0]}.org/{'/'.join(some[1:])}-{number(1, 3)}",
        lambda: f"{some[0]}.{number(2, 2)}@{some[1]}{number(1, 1)}.com",
        lambda: "".join(some),
        lambda: "".join(some).upper(),
    ))()


def decoyed(text: str, rng: random.Random, share: float = 0.1) -> str:
    """The text with a share of its words replaced by harmless look-alikes,
    every other one between the separators that secrets may have."""
    own = WORDS.findall(text[:20_000])

    def word(m: re.Match) -> str:
        if rng.random() >= share:
            return m[0]
        made = _decoy(own, rng)
        return made if rng.random() < 0.5 else rng.choice(own) + rng.choice(SEPARATORS) + made + rng.choice(TRAILS)

    return WORDS.sub(word, text) if own else text
