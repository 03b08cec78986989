"""Made-up, labelled spans for the personal-data model: a fixed set of rows, the same on every run."""

from __future__ import annotations

import random

ROWS_PER_CASE = 60
#: Words before "at" that say where something is: no one's name.
PLACED = tuple("available found hosted online us me it out here look is are was up live page site website blog visit located".split())


def _luhn_number(rnd: random.Random, prefix: str, n: int) -> str:
    digits = prefix + "".join(rnd.choice("0123456789") for _ in range(n - 1 - len(prefix)))
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def labelled_spans(seed: int = 5) -> list[dict]:
    """Rows of gen (number of the generator), str, before, after, label."""
    rnd = random.Random(seed)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda a=3, b=8: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(a, b)))
    grouped = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    tld = lambda: rnd.choice(["com", "org", "net", "de", "fr", "io"])
    year = lambda: str(rnd.randint(1900, 2040))
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    block = lambda: "".join(rnd.choice("0123456789ABCDEFGH") for _ in range(4))
    two = lambda: f"{rnd.randint(1, 28):02d}"
    card = lambda: _luhn_number(rnd, rnd.choice("3456"), 16)
    cases = (
        (0, 1, lambda: f"{word()}.{digits(2)}(at){word()}(dot){tld()}"),
        (0, 1, lambda: f"{word()} [at] {word()} [dot] {tld()}"),
        (0, 1, lambda: f"{word()} at {word()} dot {tld()}"),
        (0, 1, lambda: f"{word()} @ {word()}.{tld()}"),
        (0, 1, lambda: f"{word()} at {word()}.{tld()}"),
        (0, 1, lambda: f"{word()}.{word()} at {word()}.{tld()}"),
        (0, 0, lambda: f"{rnd.choice(PLACED)} at {word()}.{tld()}"),
        (0, 0, lambda: f"{word()} at {word()}.{word().title()}"),
        (0, 0, lambda: f"{word()} at {word()} dot {word(5, 9)}"),
        (0, 0, lambda: f"{word()} at {digits(2)}.{digits(2)}"),
        (1, 1, lambda: f"({rnd.randint(200, 989)}) {digits(3)}-{digits(4)}"),
        (1, 1, lambda: f"{rnd.randint(200, 989)}-{digits(3)}-{digits(4)}"),
        (1, 1, lambda: f"{rnd.randint(200, 989)}.{digits(3)}.{digits(4)}"),
        (1, 1, lambda: f"{rnd.randint(200, 989)} {digits(3)} {digits(4)}"),
        (1, 0, lambda: f"{year()}-{two()}-{two()}"),
        (1, 0, lambda: f"{two()}.{two()}.{year()}"),
        (1, 0, lambda: f"{year()}-{year()}"),
        (1, 0, lambda: digits(rnd.randint(4, 9))),
        (1, 0, lambda: digits(16)),
        (1, 0, lambda: f"{digits(4)} {digits(4)}"),
        (1, 0, lambda: f"{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}"),
        (1, 0, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        (2, 1, lambda: card()),
        (2, 1, lambda: grouped(card(), " ")),
        (2, 1, lambda: grouped(card(), "-")),
        (2, 1, lambda: _luhn_number(rnd, "37", 15)),
        (2, 0, lambda: "1" + digits(12)),
        (2, 0, lambda: digits(rnd.randint(13, 19))),
        (2, 0, lambda: f"978{digits(10)}"),
        (2, 0, lambda: " ".join(digits(2) for _ in range(8))),
        (3, 1, lambda: ":".join(hexa(rnd.randint(3, 4)) for _ in range(8))),
        (3, 1, lambda: "2001:0db8:" + ":".join(hexa(4) for _ in range(6))),
        (3, 0, lambda: ":".join(digits(2) for _ in range(8))),
        (4, 1, lambda: f"{rnd.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
        (4, 1, lambda: f"{rnd.choice(['DE', 'FR', 'ES'])}{digits(20)}"),
        (4, 0, lambda: f"{rnd.choice(['AB', 'XK', 'PN'])}{digits(2)} {block()} {block()}"),
        (4, 0, lambda: f"AB{digits(2)}{block()}{block()}"),
        (5, 1, lambda: f'{rnd.choice(["token", "api_key", "secret"])} = "{hexa(rnd.choice([32, 40, 64]))}'),
        (5, 1, lambda: f"password: {word(4, 6)}{digits(4)}{word(4, 6).upper()}{digits(2)}"),
        (5, 0, lambda: f"key: {word(12, 18)}"),
        (5, 0, lambda: f"token = {word(6, 8)}_{word(6, 8)}"),
        (6, 1, lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"),
        (6, 0, lambda: f"{rnd.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"),
    )
    good = ("call ", "my phone ", "contact: ", "card no. ", "mail me: ", "reach us ")
    bad = ("ISBN ", "order ", "version ", "invoice #", "page ", "item ", "between ")
    rows = []
    for _ in range(ROWS_PER_CASE):
        for gen, label, make in cases:
            said = rnd.choice(good if label else bad) if rnd.random() < 0.3 else ""
            before = (f"{word()} {word()} {said}" if said else f"{word()} {word()} {word()} ")[-24:]
            rows.append({"gen": gen, "str": make(), "before": before, "after": rnd.choice([" ", ".", ",", "\n", ""]), "label": label})
    return rows
