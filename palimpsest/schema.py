"""The canonical tables as Spark schemas."""

LINK = "pattern_id long, format_version int, kind int, prev long, next long, sibling long, source_hash long, sequence_num int, ts_unix long, flags int, perms_byte int"
PATTERNS = f"collection string, idx long, text string, embedding array<float>, sign_words array<long>, dim int, link struct<{LINK.replace(' ', ':').replace(',:', ',')}>, meta map<string,string>"
COLLECTIONS = "collection string, path string, name string, role string, kind string, dim int, n_patterns long, mount_seq int, fingerprint string, version string, briefing string, owner_id string, owner_perms string, group_perms string, world_perms string, group_id string, max_patterns int, is_split boolean"
EDGES = "from_collection string, from_idx long, to_collection string, to_idx long, kind string, score double, text_overlap double"
ACTIVITY = "pack string, event_type string, summary string, pattern_idx long, metadata string, agent_label string, created_at timestamp"

#: Flags of a link (fixed values of the format).
TOMBSTONE, PINNED, HAS_PARENT, HAS_CHILD, HAS_SIBLING, PERISH_MASK = 0x01, 0x02, 0x04, 0x08, 0x10, 0x60
#: Two bits of the flags say how a pattern perishes: with time, by a newer one, never (fixed values).
VOLATILE, REPLACEABLE, ARCHIVAL = 0x00, 0x20, 0x40
#: Forms of a link: with and without permissions; kinds of a collection (fixed values).
LEGACY_FORM, FORM, AGENT_MEMORY = 1, 2, 1
#: Permission bits (fixed values of the format).
PERM_R, PERM_W, PERM_D, PERM_A = 0x01, 0x02, 0x04, 0x08
