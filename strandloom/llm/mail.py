"""The text of a mail message with its encoded parts decoded, for word-level operators."""

from __future__ import annotations

import binascii
import quopri
import re

_ENCODED = re.compile(r"base64|quoted-printable", re.I)
_GAP = re.compile(r"\r\n\r\n|\n\n|\r\r|\n\r\n|\r\n\n")
_FOLD = re.compile(r"(?:\r\n|\r|\n)[ \t]+")
_ENCODING = re.compile(r"^content-transfer-encoding:[ \t]*\"?([\w-]+)", re.I | re.M)
_TYPE = re.compile(r"^content-type:[ \t]*([\w.+-]+)/", re.I | re.M)
_CHARSET = re.compile(r"^content-type:.*?charset=[ \t]*\"?([^\s\";]+)", re.I | re.M)
_BOUNDARY = re.compile(r"^content-type:.*?boundary=[ \t]*(?:\"([^\"]+)\"|([^\s;]+))", re.I | re.M)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
_WORD = re.compile(r"[^\W_]+")
DEPTH = 16


def _text(data: bytes, charset: str) -> str:
    try:
        return data.decode(charset, "replace")
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def _body(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        letters = _NOT_BASE64.sub("", body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]  # a cut-off part ends anywhere
        return _text(binascii.a2b_base64(letters + "=" * (-len(letters) % 4)), charset)
    if encoding == "quoted-printable":
        try:
            data = body.encode(charset, "replace")
        except (LookupError, ValueError):
            data = body.encode("utf-8", "replace")
        return _text(quopri.decodestring(data), charset)
    return body


def decoded(text: str, depth: int = 0) -> str:
    """The message with base64 and quoted-printable text in clear; everything else stays where it was."""
    if not _ENCODED.search(text):
        return text
    gap = _GAP.search(text)
    if gap is None:
        return text
    head, body = text[: gap.start()], text[gap.end() :]
    fields = _FOLD.sub(" ", head).replace("\r", "\n")
    if (bounds := _BOUNDARY.search(fields)) and depth < DEPTH:
        mark = re.escape(bounds[1] or bounds[2])
        parts = re.split(rf"(?:^|(?<=[\r\n]))--{mark}(?:--)?[ \t]*(?:\r\n|\r|\n|$)", body)
        if len(parts) > 1:
            return "\n".join([head, *(decoded(part, depth + 1) for part in parts)])
    kind = _TYPE.search(fields)
    family = kind[1].lower() if kind else "text"
    if family == "message" and depth < DEPTH:
        return f"{head}\n{decoded(body, depth + 1)}"
    encoding = _ENCODING.search(fields)
    if encoding is None or family not in ("text", "multipart"):
        return text
    charset = _CHARSET.search(fields)
    return f"{head}\n{_body(body, encoding[1].lower(), charset[1] if charset else 'utf-8')}"


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, lower-cased."""
    if text.isascii() or "İ" not in text:  # the one letter whose lower case is no longer a single letter
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]
