"""Explicit schemas and closed vocabularies of recovered content."""

from __future__ import annotations

from enum import IntEnum

class Outcome(IntEnum):
    COMPLETE, PARTIAL, USAGE, CONFLICT, FAILED, INTERRUPTED = 0, 1, 2, 3, 4, 130


ANCESTRY = "array<struct<kind:string,identifier:string,original_name:string>>"
DIAGNOSTICS = "array<struct<code:string,detail:string>>"
DETECTION = "struct<media_type:string,group:string,extension:string,method:string,container:string,reason:string,registry_version:int>"
#: What enters a level of the expansion; ``room`` is what the tightest ancestor's budget, ``room_owner``'s, leaves.
NODE = f"visit array<long>, parents array<string>, digests array<string>, depth int, name string, source_path string, ancestry {ANCESTRY}, metadata map<string,string>, diagnostics {DIAGNOSTICS}, atomic boolean, mail_leaf boolean, payload binary, reason string, room long, room_owner string"
OCCURRENCE = f"occurrence_id string, sort_key array<string>, sort_key_json string, source_path string, source_root string, ancestry {ANCESTRY}, original_name string, generated_name string, detection {DETECTION}, status string, digest string, size long, reason string, diagnostics {DIAGNOSTICS}, metadata map<string,string>"
CONTAINER = f"container_id string, sort_key array<string>, sort_key_json string, kind string, digest string, source_path string, ancestry {ANCESTRY}, status string, reason string, member_count long, expanded_bytes long"
