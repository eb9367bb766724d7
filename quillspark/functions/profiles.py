"""Script profiles: what counts as a letter of prose, and where sentences end."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    letter: str
    ends: str
    paragraph_break: str
    numerals: dict[str, str]


#: Numerals that may stand for small numbers.
HAN = Profile("[一-鿿㐀-䶿]", "。！？!?", r"(?U)\n\s*\n", {"1": "一", "2": "二两", "3": "三", "4": "四", "5": "五", "6": "六", "7": "七", "8": "八", "9": "九", "10": "十"})
LATIN = Profile("[A-Za-zÀ-ÿ]", ".。！？!?", r"\n", {})
