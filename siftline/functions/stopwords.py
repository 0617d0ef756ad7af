"""Stop words by language, shortest first."""

from __future__ import annotations

from ..plans.errors import InvalidRequest

_ENGLISH = """
a i be he me we if of an in on do no so to up mr or as is us at it by my had did and see she the one are all him can
man men who two her for our has was his its not but out you now may any said good made like time some were more have
much such with will them from than been then when upon down into over your this that what must know they only very
could would there these which other after their great first about should little before
"""
_GERMAN = """
am im um an in so er es zu und die sie wie auf ich bei dem vom zum man den ein von war der mir vor nur zur für das des
bis als aus hat mit ist sind wird eine nach sich noch auch kann aber über oder dass gibt wurde siehe durch einem haben
einen einer unter eines nicht werden wurden zwischen bezeichnet
"""
_SETS = {"en": frozenset(_ENGLISH.split()), "de": frozenset(_GERMAN.split())}


def stopword_set(language: str) -> frozenset[str]:
    try:
        return _SETS[language]
    except KeyError:
        raise InvalidRequest(f"no stop words for {language!r}; there are {sorted(_SETS)}") from None
