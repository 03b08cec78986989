"""Texts that reach every phrase and every form of the rule tables, for the rule queries: no table of the driver has any."""

from __future__ import annotations

from vispark.operators.rule_tables import PAIRS, PHRASES

_PLAIN = (
    "Cả nhóm nổ lực, chia sẽ cùng nhau.",
    "NỔ LỰC của đội, Chia sẽ",
    "Anh ấy sữa chửa xe trong một tiếng nữa thôi",
    "Tôi mất nữa tiếng chờ",
    "Chúng tôi sử lý việc này; 😀 sản suất",
    "Hôm nay trời đẹp.",
)


def rule_texts() -> tuple[str, ...]:
    """Each phrase in three cases and split by a line end; each form bare, among its own cues and among its rival's."""
    out = list(_PLAIN)
    for wrong, *_ in PHRASES:
        out.append(f"Hôm qua {wrong}. {wrong.capitalize()}, rồi {wrong.upper()} {wrong.replace(' ', chr(10))}!")
    for _, *forms in PAIRS:
        for own, other in (forms, forms[::-1]):
            out.append(f"{own[0]}.")
            for _, _, _, before, after in (own, other):
                for k in range(max(len(before), len(after))):
                    left, right = before[k % len(before)] if before else "", after[k % len(after)] if after else ""
                    out.append(f"{left} {own[0].capitalize()}, {right} xyz {left} abc {own[0]} {right} {right}".strip())
    return tuple(out)
