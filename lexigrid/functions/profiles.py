"""Token profiles: an alphabet, and the rewrites that lead to it, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# The transliteration's digraphs, longest first, and its codes for runs of i and e.
DIGRAPHS = (("cth", "T"), ("cph", "P"), ("cfh", "F"), ("ckh", "K"), ("ch", "C"), ("sh", "S"))
RUNS = (("iiii", "4"), ("iii", "3"), ("ii", "2"), ("i", "1"), ("eeee", "9"), ("eee", "8"), ("ee", "7"), ("e", "6"))
CONSONANTS = "pftkdjmngsrylqx"
#: Marks that part words: word space, uncertain space, line break, uncertain break.
SEPARATORS = ".,/\\"


@dataclass(frozen=True)
class Profile:
    """``rewrites``: (what, by what, whether a pattern), in order; ``order``: the alphabet as it is shown."""

    name: str
    order: str
    rewrites: tuple[tuple[str, str, bool], ...] = ()
    display: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def alphabet(self) -> frozenset[str]:
        return frozenset(self.order)


_LITERAL = tuple((a, b, False) for a, b in DIGRAPHS)

EVA_DISTINCT = Profile(
    "eva_distinct",
    CONSONANTS + "CSTPFK" + "oa" + "1234" + "6789",
    _LITERAL + tuple((a, b, False) for a, b in RUNS),
    {b: a for a, b in DIGRAPHS + RUNS},
)
EVA_COLLAPSED = Profile(
    "eva_collapsed",
    CONSONANTS + "CSTPFK" + "oa" + "IE",
    (*_LITERAL, ("i{1,4}", "I", True), ("e{1,4}", "E", True)),
    {b: a for a, b in DIGRAPHS},
)
IDENTITY = Profile("identity", "abcdefghijklmnopqrstuvwxyz")

PROFILES = {p.name: p for p in (EVA_DISTINCT, EVA_COLLAPSED, IDENTITY)}
