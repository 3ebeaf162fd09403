"""Plan-time settings: they decide which expressions are built, never which rows run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace

# Section and key of a nested settings file -> flat field name.
_SECTIONS = {
    "engines": {
        "ner": "enable_ner",
        "regex": "enable_regex",
        "dictionaries": "enable_dictionaries",
        "context_rules": "enable_context_rules",
    },
    "pi_types": {
        "names": "redact_names",
        "emails": "redact_emails",
        "phones": "redact_phones",
        "employee_ids": "redact_emp_ids",
        "asset_ids": "redact_asset_ids",
        "ip_addresses": "redact_ip_addresses",
        "urls": "redact_urls",
        "hostnames": "redact_hostnames",
        "companies": "redact_companies",
        "locations": "redact_locations",
        "credentials": "redact_credentials",
        "government_ids": "redact_government_ids",
        "banking": "redact_banking",
        "financial": "redact_financial",
        "dob": "redact_dob",
        "ticket_ids": "redact_ticket_ids",
        "active_directory": "redact_active_directory",
        "remote_access_ids": "redact_remote_access_ids",
        "database_strings": "redact_database_strings",
        "session_tokens": "redact_session_tokens",
        "encryption_keys": "redact_encryption_keys",
        "workplace_info": "redact_workplace_info",
        "cloud_ids": "redact_cloud_ids",
        "license_keys": "redact_license_keys",
        "chat_handles": "redact_chat_handles",
        "audit_info": "redact_audit_info",
    },
    "tokens": {
        "default": "replacement_token",
        "use_typed": "use_typed_tokens",
        "use_granular": "use_granular_tokens",
    },
    "data_cleaning": {
        "enabled": "enable_data_cleaning",
        "nfkc_normalize": "clean_nfkc_normalize",
        "normalize_unicode": "clean_normalize_unicode",
        "decode_html": "clean_decode_html",
        "normalize_whitespace": "clean_normalize_whitespace",
        "strip_control_chars": "clean_strip_control_chars",
        "strip_zero_width": "clean_strip_zero_width",
    },
    "exclusions": {
        "emails": "excluded_emails",
        "phones": "excluded_phones",
        "terms": "excluded_terms",
        "domains": "excluded_domains",
    },
    "error_handling": {
        "continue_on_error": "continue_on_error",
        "max_errors": "max_errors",
        "error_log_file": "error_log_file",
        "include_original_in_log": "include_original_in_log",
    },
}


@dataclass(frozen=True)
class CustomPattern:
    """A user-supplied detector: a Java regular expression and the token it becomes."""

    name: str
    pattern: str
    token: str
    layer: int = 13
    enabled: bool = True


@dataclass(frozen=True)
class RedactionConfig:
    # detection engines
    enable_ner: bool = False
    enable_regex: bool = True
    enable_dictionaries: bool = True
    enable_context_rules: bool = True
    enable_data_cleaning: bool = True

    # what to look for
    redact_names: bool = True
    redact_emails: bool = True
    redact_phones: bool = True
    redact_emp_ids: bool = True
    redact_asset_ids: bool = True
    redact_ip_addresses: bool = True
    redact_urls: bool = True
    redact_hostnames: bool = True
    redact_companies: bool = True
    redact_locations: bool = True
    redact_credentials: bool = True
    redact_government_ids: bool = True
    redact_banking: bool = True
    redact_financial: bool = True
    redact_dob: bool = True
    redact_ticket_ids: bool = True
    redact_active_directory: bool = True
    redact_remote_access_ids: bool = True
    redact_database_strings: bool = True
    redact_session_tokens: bool = True
    redact_encryption_keys: bool = True
    redact_workplace_info: bool = True
    redact_cloud_ids: bool = True
    redact_license_keys: bool = True
    redact_chat_handles: bool = True
    redact_audit_info: bool = True

    # tokens
    replacement_token: str = "[REDACTED]"
    use_typed_tokens: bool = True
    use_granular_tokens: bool = True

    # cleaning
    clean_nfkc_normalize: bool = True
    clean_normalize_unicode: bool = True
    clean_decode_html: bool = True
    clean_normalize_whitespace: bool = True
    clean_strip_control_chars: bool = True
    clean_strip_zero_width: bool = True
    clean_fix_encoding: bool = True
    clean_digit_groups: bool = True

    # row errors: go on or fail at the first, fail from so many on (0: never), where the error table goes
    continue_on_error: bool = True
    max_errors: int = 0
    error_log_file: str = ""
    include_original_in_log: bool = False

    # exclusions and extensions
    excluded_emails: frozenset[str] = frozenset()
    excluded_phones: frozenset[str] = frozenset()
    excluded_terms: frozenset[str] = frozenset()
    excluded_domains: frozenset[str] = frozenset()
    custom_patterns: tuple[CustomPattern, ...] = ()
    luhn_check: bool = False
    only: frozenset[str] = field(default=frozenset())
    """Detector ids (``DET7``, ``NAM3`` ...) to keep; empty keeps all."""

    def __post_init__(self) -> None:
        for name in ("excluded_emails", "excluded_domains", "excluded_terms"):
            object.__setattr__(self, name, frozenset(v.lower() for v in getattr(self, name)))
        object.__setattr__(self, "excluded_phones", frozenset(self.excluded_phones))
        object.__setattr__(self, "only", frozenset(self.only))

    def with_(self, **changes: object) -> RedactionConfig:
        return replace(self, **changes)

    def repaired(self) -> RedactionConfig:
        """Switch a useful minimum back on when everything was switched off."""
        changes: dict[str, bool] = {}
        if not (self.enable_ner or self.enable_regex or self.enable_dictionaries):
            changes["enable_regex"] = True
        basic = (
            "names", "emails", "phones", "emp_ids", "asset_ids",
            "ip_addresses", "urls", "hostnames", "credentials",
        )
        if not any(getattr(self, f"redact_{kind}") for kind in basic):
            changes |= {f"redact_{kind}": True for kind in ("emails", "phones", "names")}
        return self.with_(**changes) if changes else self

    def to_dict(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "custom_patterns":
                value = [vars(p) for p in value]
            elif isinstance(value, frozenset):
                value = sorted(value)
            out[f.name] = value
        return out

    @classmethod
    def from_dict(cls, data: dict[str, object]) -> RedactionConfig:
        """Build from a flat dict, from a nested settings file, or from a mix of both."""
        known = {f.name for f in fields(cls)}
        flat = {k: v for k, v in data.items() if k in known}
        for section, keys in _SECTIONS.items():
            for key, value in (data.get(section) or {}).items():
                if key in keys:
                    flat[keys[key]] = value
        custom = flat.get("custom_patterns") or ()
        flat["custom_patterns"] = tuple(_custom(c) for c in custom)
        for name, value in flat.items():
            if name.startswith("excluded_") or name == "only":
                flat[name] = frozenset(value or ())
        return cls(**flat)


def _custom(row: CustomPattern | dict[str, object]) -> CustomPattern:
    if isinstance(row, CustomPattern):
        return row
    token = row.get("token") or row.get("replacement") or f"[{str(row['name']).upper()}]"
    return CustomPattern(
        name=str(row["name"]),
        pattern=str(row["pattern"]),
        token=str(token),
        layer=int(row.get("layer", 13)),
        enabled=bool(row.get("enabled", True)),
    )


def only(*detectors: str, **changes: object) -> RedactionConfig:
    """A config that keeps just the named detectors."""
    return RedactionConfig(only=frozenset(detectors), **changes)


def as_set(values: Iterable[str] | None) -> frozenset[str]:
    return frozenset(v.lower() for v in (values or ()))
