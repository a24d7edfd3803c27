"""Members of archives, read under limits: all pass, or the archive fails with a reason."""

from __future__ import annotations

import io
import stat
import tarfile
import zipfile
from typing import NamedTuple

import zstandard

from ..functions.identify import TAR_ENDINGS, identify
from ..functions.text import is_unsafe, order_pair
from ..operators.policy import Policy


class Failed(Exception):
    """A container is refused; ``owner`` is the ancestor whose budget it was that ended, if it wasn't its own."""

    def __init__(self, reason: str, owner: str | None = None):
        super().__init__(reason)
        self.reason, self.owner = reason, owner


class Member(NamedTuple):
    name: str
    index: int
    declared: int
    packed: int | None
    payload: bytes


def _demand(holds: bool, reason: str) -> None:
    if not holds:
        raise Failed(reason)


def declared_reason(size: int, packed: int | None, policy: Policy) -> str | None:
    """Why a member of a declared size is refused; None if it isn't."""
    if size > policy.max_member_bytes:
        return "member_size_limit"
    if size and packed is not None and size / max(packed, 1) > policy.max_expansion_ratio:
        return "expansion_ratio_limit"
    return None


def _accept(reason: str | None) -> None:
    if reason is not None:
        raise Failed(reason)


def tightest(bounds: list[tuple[int, str]]) -> tuple[int, str]:
    """The least bound and its reason; on a tie the first named decides."""
    return min(bounds, key=lambda b: b[0])


class Budget:
    """What a container may still expand to: its own budget, the run's and that of its tightest ancestor."""

    def __init__(self, policy: Policy, room: int | None = None, owner: str | None = None):
        self.policy, self.spent, self.owner = policy, 0, owner
        self.rooms = [(policy.max_run_bytes, "global_size_limit")]
        if room is not None:
            self.rooms.append((room, "ancestor"))
        self.rooms.append((policy.max_container_bytes, "container_size_limit"))

    def fail(self, reason: str) -> None:
        raise Failed("container_size_limit", self.owner) if reason == "ancestor" else Failed(reason)

    def declare(self, total: int) -> None:
        for room, reason in self.rooms:
            if total > room:
                self.fail(reason)

    def all(self, stream) -> bytes:
        """All of a stream, however it is divided."""
        most, reason = tightest(self.rooms)
        data = stream.read(most + 1)
        if len(data) > most:
            self.fail(reason)
        return data

    def read(self, stream, packed: int | None) -> bytes:
        """All of a member, of which no more than the tightest bound is ever read."""
        bounds = [(self.policy.max_member_bytes, "member_size_limit"), *[(room - self.spent, reason) for room, reason in self.rooms]]
        if packed is not None:
            bounds.append((int(max(packed, 1) * self.policy.max_expansion_ratio), "expansion_ratio_limit"))
        most, reason = tightest(bounds)
        data = stream.read(most + 1)
        if len(data) > most:
            self.fail(reason)
        self.spent += len(data)
        return data


def _portable(named: list[tuple[str, int]]) -> list[int]:
    return [i for _, i in sorted(((order_pair(n), i) for n, i in named))]


def zip_members(raw: bytes, policy: Policy, budget: Budget) -> list[Member]:
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = z.infolist()
            _demand(len(infos) <= policy.max_members_per_container, "member_count_limit")
            order = [i for i in _portable([(x.filename, i) for i, x in enumerate(infos)]) if not infos[i].is_dir()]
            for i in order:
                x = infos[i]
                _demand(not is_unsafe(x.filename), "unsafe_path")
                _demand(stat.S_IFMT(x.external_attr >> 16) in (0, stat.S_IFREG), "unsafe_entry")
                _demand(not x.flag_bits & 1, "encrypted_archive")
                _accept(declared_reason(x.file_size, x.compress_size, policy))
            budget.declare(sum(infos[i].file_size for i in order))
            for i in order:
                x = infos[i]
                with z.open(x) as f:  # reading to the end checks the CRC
                    data = budget.read(f, x.compress_size)
                out.append(Member(x.filename, i, x.file_size, x.compress_size, data))
    except RuntimeError as e:
        said = str(e).casefold()
        raise Failed("encrypted_archive" if "password" in said or "encrypted" in said else "corrupt_archive") from e
    except (OSError, EOFError, ValueError, NotImplementedError, zipfile.BadZipFile, zipfile.zlib.error) as e:
        raise Failed("corrupt_archive") from e
    for m in out:
        _accept(declared_reason(len(m.payload), m.packed, policy))
    return out


def tar_members(raw: bytes, policy: Policy, budget: Budget) -> list[Member]:
    out = []
    try:
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as f:
                raw = Budget(policy, budget.rooms[1][0] if len(budget.rooms) > 2 else None, budget.owner).all(f)
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
            infos = t.getmembers()
            _demand(len(infos) <= policy.max_members_per_container, "member_count_limit")
            order = _portable([(x.name, i) for i, x in enumerate(infos)])
            for i in order:
                _demand(not is_unsafe(infos[i].name), "unsafe_path")
                _demand((infos[i].isdir() or infos[i].isreg()) and not infos[i].issparse(), "unsafe_entry")
            order = [i for i in order if infos[i].isreg()]
            budget.declare(sum(infos[i].size for i in order))
            for i in order:
                _demand(infos[i].size <= policy.max_member_bytes, "member_size_limit")
                with t.extractfile(infos[i]) as f:
                    data = budget.read(f, None)
                _demand(len(data) == infos[i].size, "corrupt_archive")
                out.append(Member(infos[i].name, i, infos[i].size, None, data))
    except (OSError, EOFError, ValueError, tarfile.TarError, zstandard.ZstdError) as e:
        raise Failed("corrupt_archive") from e
    return out


def members(kind: str, raw: bytes, policy: Policy, room: int | None = None, owner: str | None = None) -> list[Member]:
    """Members in portable order. 7z needs a library that isn't at hand, and fails as unsupported."""
    budget = Budget(policy, room, owner)
    if kind == "zip":
        return zip_members(raw, policy, budget)
    if kind == "tar":
        return tar_members(raw, policy, budget)
    raise Failed("unsupported_container")


_PACKED = (b"PK", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\0", b"\x28\xb5\x2f\xfd")


def may_expand(raw: bytes, name: str) -> bool:
    """Whether the bytes could be an archive, by their first ones or the name."""
    return raw.startswith(_PACKED) or raw[257:262] == b"ustar" or name.casefold().endswith(TAR_ENDINGS)


def declared_bytes(raw: bytes, name: str) -> int:
    """Bytes that an archive's own lists say it holds, without reading a member; 0 where there is no list to be had cheaply."""
    try:
        kind = identify(raw, name).container
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return sum(i.file_size for i in z.infolist() if not i.is_dir())
        if kind == "tar" and raw[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
                return sum(m.size for m in t if m.isreg())
    except (OSError, EOFError, ValueError, RuntimeError, NotImplementedError, zipfile.BadZipFile, tarfile.TarError):
        pass
    return 0
