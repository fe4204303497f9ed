"""Errors of the language, by their W3C codes."""

from __future__ import annotations

import re


class XPathError(Exception):
    """An error with a code such as XPST0003."""

    code = "FOER0000"

    def __init__(self, code: str, message: str = "") -> None:
        self.code = code
        super().__init__(f"[err:{code}] {message}")


class XPathSyntaxError(XPathError, SyntaxError):
    """A static error of grammar."""


class XPathNameError(XPathError, NameError):
    """An unknown name, variable, function or prefix."""


class XPathTypeError(XPathError, TypeError):
    """A wrong type or number of arguments."""


class XPathValueError(XPathError, ValueError):
    """A value that an operation refuses."""


class XPathArithmeticError(XPathError, ArithmeticError):
    """Division by zero or overflow."""


class XPathLookupError(XPathError, LookupError):
    """A document, collection, map key or array member that is not there."""


class UnsupportedError(XPathError, NotImplementedError):
    """An expression that this engine has no distributed plan for."""


_KINDS = (
    (r"XPST0003|XPST0010|XQST0039", XPathSyntaxError),
    (r"XPST0008|XPST0017|XPST0051|XPST0081|FONS0004", XPathNameError),
    (r"FOAR000\d", XPathArithmeticError),
    (r"FODC\d+|FOAY0001|XQDY0137|FOUT1170", XPathLookupError),
    (r"XP[SD][TY]00\d\d|XPTY\d+|XPDY\d+|FORG0006|FOTY\d+", XPathTypeError),
)


def error(code: str, message: str = "") -> XPathError:
    """The error of a code, as the class that fits it."""
    for pattern, kind in _KINDS:
        if re.fullmatch(pattern, code):
            return kind(code, message)
    return XPathValueError(code, message)


def from_spark(problem: BaseException) -> XPathError | None:
    """The XPath error that a failed Spark job tells, if it tells one."""
    found = re.search(r"\[err:([A-Z]{4}\d{4})\] ?([^\n]*)", str(problem))
    if found:
        return error(found[1], found[2])
    if "DIVIDE_BY_ZERO" in str(problem):
        return error("FOAR0001", "division by zero")
    return None
