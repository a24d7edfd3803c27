"""Mailboxes and messages: recognition, and the parts of a message that aren't display bodies."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from email import policy as email_policy
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage, Message
from email.parser import BytesParser, Parser
from functools import cache, lru_cache


class _Headers(HeaderRegistry):
    """The parsed headers of ``email``, made once: its registry makes a class for each access, and parses the value each time."""

    def __init__(self):
        super().__init__()
        self._made = lru_cache(1024)(super().__getitem__)
        self._short = lru_cache(4096)(self._parsed)

    def __getitem__(self, name):
        return self._made(name)

    def _parsed(self, name, value):
        return super().__call__(name, value)

    def __call__(self, name, value):
        # parsed values are immutable; long ones aren't kept, nor are objects that were parsed already
        return self._short(name, value) if type(value) is str and len(name) + len(value) <= 1000 else self._parsed(name, value)


HEADERS = _Headers()
POLICY = email_policy.default.clone(utf8=True, refold_source="none", raise_on_defect=False, header_factory=HEADERS)
#: Of messages that are made here.
MADE = email_policy.default.clone(header_factory=HEADERS)
IDENTITY = ("message-id", "date", "from", "to", "subject")
HEAD_BYTES = 1 << 16
_IDENTITY = re.compile(rb"(?i)(?:^|[\r\n])(?:" + "|".join(IDENTITY).encode() + rb"):")
#: How a line begins that the parser takes for one of a header.
_FIELD = re.compile(rb"From |[!-9;-~]*:|[\t ]")
#: In no line of base64.
_BOUNDARY = "=" * 15 + "%019d" % 1970 + "=="


def made(headers: list[tuple[str, str]], body: str, payload: bytes, filename: str) -> bytes:
    """A message with a body and an attachment, all short ASCII but the payload, as ``EmailMessage`` writes it."""
    head = "".join(f"{k}: {v}\n" for k, v in headers)
    lead = f'{head}MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="{_BOUNDARY}"\n\n--{_BOUNDARY}\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 7bit\n\n{body}\n\n--{_BOUNDARY}\n'
    lead += f'Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename="{filename}"\nMIME-Version: 1.0\n\n'
    return b"".join((lead.encode("ascii"), base64.encodebytes(payload), f"\n--{_BOUNDARY}--\n".encode("ascii")))


@lru_cache(1024)
def _fields(head: str) -> tuple[tuple[str, str], ...] | None:
    """Names and raw values of a head without defects."""
    message = Parser(policy=POLICY).parsestr(head + "\n\n", headersonly=True)
    plain = head and not message.defects and message.get_payload() == "" and message.get_unixfrom() is None
    return tuple(message.raw_items()) if plain else None


def _headed(head: str) -> Message | None:
    fields = _fields(head) if len(head) <= 4000 else None
    if fields is None:
        return None
    message = EmailMessage(POLICY)
    for name, value in fields:
        message.set_raw(name, value)
    return message


def _flat(text: str) -> Message | None:
    """What the parser makes of a multipart message whose parts are leaves, with all in its place; None for any other.

    The parser looks at each line of the parts several times; here it gets only their headers.
    """
    head, blank, body = text.partition("\n\n")
    message = None if "\r" in text or not blank or head.startswith("\n") else _headed(head)
    if message is None or message.get_content_maintype() != "multipart" or message.get_content_type() == "multipart/digest" or "Content-Transfer-Encoding" in message or not message.get_boundary():
        return None
    mark, at = "--" + message.get_boundary(), 0
    if not body.startswith(mark):
        return None
    while True:
        line = body.find("\n", at)
        line = len(body) if line < 0 else line
        rest = body[at + len(mark) : line].rstrip(" \t")
        if rest == "--":
            message.epilogue = body[line + 1 :]
            return message if message.is_multipart() else None
        after = body.find("\n" + mark, line)
        if rest or after <= line:
            return None
        head, blank, inner = body[line + 1 : after + 1].partition("\n\n")
        part = _headed(head) if blank and not head.startswith("\n") else None
        if part is None or part.get_content_maintype() in ("multipart", "message"):
            return None
        part.set_payload(inner.removesuffix("\n"))  # the last one is the boundary's
        message.attach(part)
        at = after + 1


def parse(raw: bytes) -> Message:
    message = _flat(raw.decode("ascii", "surrogateescape"))
    return BytesParser(policy=POLICY).parsebytes(raw) if message is None else message


def parse_head(raw: bytes) -> Message:
    """The headers; the body stays one text."""
    return BytesParser(policy=POLICY).parsebytes(raw, headersonly=True)


def has_evidence(message: Message) -> bool:
    """Two identity headers, or one beside a structural header."""
    seen = {k.casefold() for k in message.keys()}
    n = sum(h in seen for h in IDENTITY)
    return n > 1 or (n == 1 and bool(seen & {"mime-version", "content-type"}))


def split_mbox(raw: bytes) -> Iterator[bytes]:
    """Messages between delimiter lines, each without one empty line that closes it."""
    at = 0 if raw.startswith(b"From ") else raw.find(b"\nFrom ") + 1 or -1
    while at >= 0:
        begin = raw.find(b"\n", at) + 1 or len(raw)
        at = raw.find(b"\nFrom ", begin - 1) + 1 or -1
        body = raw[begin : at if at >= 0 else len(raw)]
        yield body[:-1] if body == b"\n" or body.endswith(b"\n\n") else body


def is_mbox(raw: bytes) -> bool:
    return raw.startswith(b"From ") and any(has_evidence(parse_head(m)) for m in split_mbox(raw))


def is_message(raw: bytes) -> bool:
    head = raw[:HEAD_BYTES]
    # headers end before the first line that isn't one's, and without one of these there is no evidence; this spares most contents the parser
    return _FIELD.match(head) is not None and _IDENTITY.search(head) is not None and has_evidence(parse_head(head))


def part_id(path: tuple[int, ...]) -> str:
    return "part-" + ".".join(str(n).zfill(4) for n in path)


def _node(kind: str, identifier: str, original: str | None = None) -> dict:
    return {"kind": kind, "identifier": identifier, "original_name": original}


def _defects(message: Message) -> list[dict]:
    return [{"code": type(d).__name__, "detail": str(d)} for d in message.defects]


def _about(message: Message, part: str, kind: str, given: str | None) -> dict[str, str]:
    """Identity headers of the part and what it says of itself; its type and file name are known."""
    about = {h: str(value) for h in IDENTITY if (value := message[h]) is not None}
    about["mime_part_path"] = part
    about["content_type"] = kind
    for key, value in (("content_disposition", message.get_content_disposition()), ("content_id", message["Content-ID"]), ("filename", given), ("name_parameter", message.get_param("name")), ("content_transfer_encoding", message["Content-Transfer-Encoding"])):
        about[key] = str(value) if value else ""
    return about


def is_display_body(message: Message, kind: str) -> bool:
    if kind.casefold() not in ("text/html", "text/plain"):
        return False
    return message.get_content_disposition() != "attachment" and message["Content-ID"] is None and message.get_filename() is None and message.get_param("name") is None


def walk(message: Message, ancestry: list[dict], path: tuple[int, ...], above: Callable[[], frozenset[str]], notes: list[dict]) -> Iterator[dict]:
    """Leaves (name, ancestry, metadata, diagnostics, payload, reason, atomic) in the parser's order. above: digests of the messages around, asked only for attached ones."""
    here = notes + _defects(message)
    inner, kind = message.get_payload(), message.get_content_type()
    if kind == "message/rfc822":
        for k, child in enumerate(inner if isinstance(inner, list) else [], 1):
            if not isinstance(child, Message):
                continue
            part = part_id((*path, k))
            raw = child.as_bytes(policy=POLICY)
            digest = hashlib.sha256(raw).hexdigest()
            at = [*ancestry, _node("mime_part", part, "attached-message.eml")]
            leaf = {"name": "attached-message.eml", "ancestry": at, "metadata": _about(message, part, kind, message.get_filename()), "diagnostics": here, "payload": raw, "reason": None, "atomic": True}
            yield leaf
            if digest in above():
                yield leaf | {"ancestry": [*at, _node("message", "cycle")], "diagnostics": [*here, {"code": "cycle", "detail": ""}], "payload": None, "reason": "cycle", "atomic": False}
            else:
                yield from walk(child, [*at, _node("message", part + "-message")], (), cache(lambda d=digest: above() | {d}), here)
    elif message.is_multipart():
        for k, child in enumerate(inner if isinstance(inner, list) else [], 1):
            if isinstance(child, Message):
                yield from walk(child, ancestry, (*path, k), above, here)
    elif not is_display_body(message, kind):
        path = path or (1,)
        part, given = part_id(path), message.get_filename()
        about, body = _about(message, part, kind, given), message.get_payload(decode=True)
        found = notes + _defects(message)  # decoding may have added some
        failed = not isinstance(body, bytes) or any("base64" in d["code"].casefold() for d in found)
        yield {
            "name": given or f"part-{path[-1]:04d}.bin", "ancestry": [*ancestry, _node("mime_part", part, given)], "metadata": about, "atomic": False,
            "diagnostics": found + ([{"code": "transfer_decode_failed", "detail": ""}] if failed else []), "payload": None if failed else body, "reason": "transfer_decode_failed" if failed else None,
        }


def message_leaves(raw: bytes, ancestry: list[dict]) -> Iterator[dict]:
    yield from walk(parse(raw), ancestry, (), cache(lambda: frozenset([hashlib.sha256(raw).hexdigest()])), [])


def mbox_leaves(raw: bytes, ancestry: list[dict]) -> Iterator[dict]:
    lost = {"name": "unattributable-mail.bin", "metadata": {}, "diagnostics": [{"code": "unattributable_mail_bytes", "detail": ""}], "payload": None, "reason": "unattributable_mail_bytes", "atomic": False}
    n = 0
    for n, one in enumerate(split_mbox(raw), 1):
        at = [*ancestry, _node("message", f"message-{n:06d}")]
        message = parse(one)
        if has_evidence(message):
            yield from walk(message, at, (), cache(lambda m=message: frozenset([hashlib.sha256(m.as_bytes(policy=POLICY)).hexdigest()])), [])
        else:
            yield lost | {"ancestry": at}
    if raw and not n:
        yield lost | {"ancestry": list(ancestry)}
