"""The detector catalogue: what to find, in which order, and what it becomes.

Each row is data. ``functions.spans`` turns the enabled rows into Catalyst
expressions. Patterns are Java regular expressions; ``(?Ud)`` is put in front of each
so that classes and ``$`` behave as they do for Unicode text.

Order matters: between two findings with the same start and length the earlier row wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from sparkveil.plans.config import RedactionConfig

VALUE, LEAD, FIRST = 0, 1, 2
"""What a finding covers: the value, everything from the start of the match to the end of
the value, or the first place in the match where the value's text occurs."""


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str
    kind: str
    sub: str | None = None
    span: int = VALUE
    icase: bool = True
    needs: str = ""
    """Cheap flag a text must carry, see ``functions.spans.FLAGS``; empty for none."""
    words: tuple[str, ...] = ()
    """A text must contain one of these (lower-case) for the pattern to be tried."""
    tokens: tuple[str, ...] = ()
    """A text must contain one of these as a whole word (lower-case)."""
    head: str = ""
    """A condition every match meets, put in front of the pattern only to fail fast."""


@dataclass(frozen=True)
class Family:
    ident: str
    layer: int
    toggle: str | None
    method: str
    confidence: float
    detectors: tuple[Detector, ...]


def _d(name: str, pattern: str, kind: str, sub: str | None = None, *words: str, **kw: object) -> Detector:
    return Detector(name, pattern, kind, sub, words=words, **kw)


# ---------------------------------------------------------------------------
# Patterns, token names, order, confidence and method of every detector.
# The single capturing group is the value; no group means the whole match is the value.
# ---------------------------------------------------------------------------
FAMILIES: tuple[Family, ...] = (
    Family("DET1", 0, "redact_credentials", "regex_critical", 1.0, (
        _d("PASSWORD", r'(?:password|pwd|pass)\s*(?:(?:is\s*[:\s])|[:\-=])\s*(\S+)', "CREDENTIAL", None, "pass", "pwd", span=LEAD),
        _d("VPN_CREDS", r'(?:vpn|remote)[\s._-]*(?:password|pwd|pass|user|username)[\s:_-]*\S+', "CREDENTIAL", "VPN", "pass", "pwd", "user"),
        _d("API_KEY", r'(?:api[_\s-]?key|access[_\s-]?token|bearer)[\s:_=-]*[A-Za-z0-9_\-]{20,}', "API_KEY", None, "key", "token", "bearer"),
        _d("SSH_KEY", r'-----BEGIN (?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----', "SSH_KEY", None, "key", icase=False),
        _d("DOMAIN_ID", r'\b(?:domain[\s._-]*id|user[\s._-]*id)[\s:._-]*\d{6,7}\b', "DOMAIN_ID", None, "domain", "user", needs="digit"),
    )),
    Family("DET2", 0, "redact_encryption_keys", "regex_critical", 1.0, (
        _d("BITLOCKER_KEY", r'\b\d{6}-\d{6}-\d{6}-\d{6}-\d{6}-\d{6}-\d{6}-\d{6}\b', "RECOVERY_KEY", None, "-", icase=False, needs="digit"),
        _d("RECOVERY_KEY", r'(?:recovery|backup|restore)[\s_-]*key[\s:_-]*([A-Za-z0-9-]{10,})\b', "RECOVERY_KEY", None, "key"),
        _d("CERT_THUMBPRINT", r'(?:thumbprint|fingerprint|sha1|sha256)[\s:_-]*([A-Fa-f0-9]{40,64})\b', "CERT_HASH", None, "print", "sha1", "sha256", needs="hex"),
        _d("CERT_SERIAL", r'(?:serial\s*(?:no|number)?)[\s:_-]*([A-Fa-f0-9]{8,40})\b', "CERT_SERIAL", None, "serial"),
    )),
    Family("DET3", 0, "redact_license_keys", "regex_critical", 0.95, (
        _d("LICENSE_KEY", r'\b[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}-[A-Z0-9]{5}(?:-[A-Z0-9]{5})?\b', "LICENSE_KEY", None, "-"),
        _d("PRODUCT_KEY", r'(?:product|license|activation|serial)[\s_-]*key[\s:_-]*([A-Za-z0-9]{5}(?:-[A-Za-z0-9]{5}){3,4})\b', "LICENSE_KEY", None, "key"),
        _d("CMDB_CI", r'\b(?:ci|config(?:uration)?\s*item|cmdb)[\s#:_-]*(?:id)?[\s#:_-]*([A-Za-z]{2,4}\d{6,10})\b', "CI_ID", None, "ci", "config", "cmdb", needs="digit"),
    )),
    Family("DET4", 0, "redact_session_tokens", "regex_critical", 1.0, (
        _d("SESSION_ID", r'(?:jsessionid|phpsessid|asp\.net_sessionid|session[_-]?id|sid)[\s:=]*([A-Za-z0-9_-]{16,64})\b', "SESSION_ID", None, "sess", "sid"),
        _d("JWT_TOKEN", r'\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b', "JWT_TOKEN", None, "eyj", icase=False, needs="dot"),
        _d("OAUTH_TOKEN", r'(?:bearer|oauth|access[_-]?token|refresh[_-]?token|auth[_-]?token)[\s:=]+([A-Za-z0-9_.-]{20,})\b', "AUTH_TOKEN", None, "token", "bearer", "auth"),
        # the same matches as [\s:]*[^;]*(?:session|auth|token|user)[^;]*=[^;\s]+ behind the word: the first keyword is
        # the one with most behind it, so the others need not be tried
        _d("COOKIE_SESSION", r'(?:cookie|set-cookie)(?=(?>[^;]*?(?:session|auth|token|user))[^;]*=[^;\s])[^;]*=[^;\s]+', "SESSION_COOKIE", None, "="),
    )),
    Family("DET5", 1, "redact_database_strings", "regex_compound", 1.0, (
        _d("DB_CONNECTION_STRING", r'''(?:connection\s*string|connstr|jdbc|odbc)[\s:=]*["\']?[^"\']*(?:password|pwd|pass)\s*=\s*[^;"\'\s]+''', "DB_CONNECTION", None, "="),
        _d("MONGODB_URI", r'mongodb(?:\+srv)?://[^:]+:[^@]+@[^\s]+', "DB_URI", None, "mongodb", needs="slash"),
        _d("DB_CREDENTIALS", r'''(?:(?:user(?:name)?|uid)\s*=\s*[^;"\'\s]+\s*;.*?(?:password|pwd|pass)\s*=\s*[^;"\'\s]+)''', "DB_CREDS", None, "="),
    )),
    Family("DET6", 2, "redact_urls", "regex", 1.0, (
        _d("URL", r'(?:https?|ftp)://[^\s<>"{}|\\^`\[\]]+', "URL", None, "://", needs="slash"),
    )),
    Family("DET7", 3, "redact_emails", "regex", 1.0, (
        _d("EMAIL", r'\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,61}[A-Za-z0-9])?\.[A-Za-z]{2,20}\b', "EMAIL", needs="at"),
        _d("EMAIL_PARTIAL_LASTNAME", r'(?<![a-zA-Z0-9])\.[a-zA-Z]{2,20}@[a-zA-Z0-9-](?:[a-zA-Z0-9-]*+(?:\.(?![a-zA-Z]{2,}+\b)[a-zA-Z0-9-]++)*+\.[a-zA-Z]{2,}+\b)++', "EMAIL", needs="at"),
    )),
    Family("DET8", 4, "redact_government_ids", "regex_high_specificity", 1.0, (
        _d("AADHAAR", r'\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b', "AADHAAR", icase=False, needs="digit"),
        _d("AADHAAR_CONTEXTUAL", r'(?:aadhaa?r|uid(?:ai)?)\s*(?:no|number|num|#|:)?[\s.:_#-]*\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', "AADHAAR", None, "aadha", "uid", needs="digit"),
        _d("PAN", r'\b[A-Z]{5}\d{4}[A-Z]\b', "PAN", needs="digit"),
        _d("PASSPORT", r'\b[A-Z]\d{7}\b', "PASSPORT", needs="digit"),
        _d("SSN", r'(?:(?:ssn|social\s*security)[\s.:_#-]*)?\b\d{3}[-]\d{2}[-]\d{4}\b', "SSN", None, "-", needs="digit"),
        _d("SSN_CONTEXTUAL", r'(?:ssn|social\s*security\s*(?:no|number|#)?|tax\s*(?:id|identification)\s*(?:no|number|#)?|taxpayer\s*(?:id|identification))[\s.:_#-]*\d{3}[-\s]?\d{2}[-\s]?\d{4}\b', "SSN", None, "ssn", "social", "tax", needs="digit"),
        _d("DRIVING_LICENSE_IN", r'\b[A-Z]{2}[\s-]?\d{2}[\s-]?\d{4}[\s-]?\d{7}\b', "DL", needs="digit"),
        _d("VEHICLE_REG_IN", r'(?:(?:vehicle|registration|reg|number\s*plate|license\s*plate|car\s*no)[\s.:_#-]*)?\b[A-Z]{2}\s?-?\d{2}\s?-?[A-Z]{1,3}\s?-?\d{4}\b', "VEHICLE_REG", needs="digit"),
        _d("NIN_UK", r'\b[A-Z]{2}\d{6}[A-Z]\b', "NIN", needs="digit"),
        _d("VOTER_ID_IN", r'(?:voter\s*(?:id|card)|epic|electoral)[\s.:_#-]*(?:no|number|#)?[\s.:_#-]*[A-Z]{3}\d{7}\b', "VOTER_ID", None, "voter", "epic", "electoral", needs="digit"),
    )),
    Family("DET9", 5, "redact_phones", "regex", 1.0, (
        _d("PHONE_91_DIRECT", r'\+91\d{10}\b', "PHONE", "IN", "+91", icase=False, needs="digit"),
        _d("PHONE_INDIAN", r'\b(?:\+?91[\s.-]?)?[6-9]\d{9}\b', "PHONE", "IN", icase=False, needs="digit"),
        _d("PHONE_INDIAN_FORMATTED", r'\b(?:\+?91[\s.-]?)?[6-9]\d[\s.-]?\d{4}[\s.-]?\d{4}\b', "PHONE", "IN", icase=False, needs="digit"),
        _d("PHONE_INDIAN_SPACED", r'\+91\s+\d[\s\d]{9,12}(?=\s|$|[^\d])', "PHONE", "IN", "+91", icase=False, needs="digit"),
        _d("PHONE_LANDLINE", r'\b0\d{2,4}[\s.-]?\d{6,8}\b', "PHONE", "IN", icase=False, needs="digit"),
        _d("PHONE_UK", r'\b\+?44[\s.-]?\d{4}[\s.-]?\d{6}\b', "PHONE", "UK", "44", icase=False, needs="digit"),
        _d("PHONE_UK_DIRECT", r'\+44\d{10}\b', "PHONE", "UK", "+44", icase=False, needs="digit"),
        _d("PHONE_UK_FULL", r'\b\+?44[\s.-]?\(?0?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{4}\b', "PHONE", "UK", "44", icase=False, needs="digit"),
        _d("PHONE_US", r'\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b', "PHONE", "US", icase=False, needs="digit"),
        _d("PHONE_TOLLFREE", r'\b1800[\s.-]?\d{3}[\s.-]?\d{4}\b', "PHONE", "TOLLFREE", "1800", icase=False, needs="digit"),
        _d("PHONE_TOLLFREE_800", r'\b800[\s.-]?\d{3}[\s.-]?\d{4}\b', "PHONE", "TOLLFREE", "800", icase=False, needs="digit"),
        _d("PHONE_AU", r'\b\+?61[\s.-]?\d{1,2}[\s.-]?\d{4}[\s.-]?\d{4}\b', "PHONE", "AU", "61", icase=False, needs="digit"),
        _d("PHONE_DE", r'\b\+?49[\s.-]?\(?0?\d{2,5}\)?[\s.-]?\d{4,10}\b', "PHONE", "DE", "49", icase=False, needs="digit"),
        _d("PHONE_FR", r'\b\+?33[\s.-]?\(?0?\)?[\s.-]?\d[\s.-]?\d{2}[\s.-]?\d{2}[\s.-]?\d{2}[\s.-]?\d{2}\b', "PHONE", "FR", "33", icase=False, needs="digit"),
        _d("PHONE_SG", r'\b\+?65[\s.-]?\d{4}[\s.-]?\d{4}\b', "PHONE", "SG", "65", icase=False, needs="digit"),
        _d("PHONE_UAE", r'\b\+?971[\s.-]?\d{1,2}[\s.-]?\d{3}[\s.-]?\d{4}\b', "PHONE", "AE", "971", icase=False, needs="digit"),
        _d("PHONE_BR", r'\b\+?55[\s.-]?\d{2}[\s.-]?\d{4,5}[\s.-]?\d{4}\b', "PHONE", "BR", "55", icase=False, needs="digit"),
        _d("PHONE_BR_MOBILE", r'\(\d{2}\)\s*\d{4,5}-\d{4}\b', "PHONE", "BR", "(", icase=False, needs="digit"),
        _d("PHONE_JP", r'\b\+?81[\s.-]?\d{1,4}[\s.-]?\d{1,4}[\s.-]?\d{4}\b', "PHONE", "JP", "81", icase=False, needs="digit"),
        _d("PHONE_CN", r'\b\+?86[\s.-]?\d{3}[\s.-]?\d{4}[\s.-]?\d{4}\b', "PHONE", "CN", "86", icase=False, needs="digit"),
        _d("PHONE_MY", r'\b\+?60[\s.-]?\d{1,2}[\s.-]?\d{3,4}[\s.-]?\d{4}\b', "PHONE", "MY", "60", icase=False, needs="digit"),
        _d("PHONE_MX", r'\b\+?52[\s.-]?\d{2}[\s.-]?\d{4}[\s.-]?\d{4}\b', "PHONE", "MX", "52", icase=False, needs="digit"),
        _d("PHONE_MX_SPACED", r'\+52\s+\d{2}\s+\d{8}\b', "PHONE", "MX", "+52", icase=False, needs="digit"),
        _d("PHONE_INTL", r'\b\+\d{1,3}[\s.-]?\d{4,14}\b', "PHONE", None, "+", icase=False, needs="digit"),
    )),
    Family("DET10", 6, "redact_emp_ids", "regex_context", 0.9, (
        _d("EMP_ID_LABELED", r'\b(?:emp(?:loyee)?[\s._-]*(?:id|no)?|eid|uid|user[\s._-]*id?)[\s:._-]*(\d{4,8})(?!-[A-Z])\b', "EMP_ID", None, "emp", "eid", "uid", "user", needs="digit"),
        _d("EMP_ID_PREFIXED", r'\b(?:ad|iada|cad|ws|pr|sa|oth|vo|da|di)\.(?:[a-z0-9]{4,}|\d{4,})\b', "EMP_ID", None, needs="dot"),
        _d("EMP_ID_IN_PARENS", r'\(\d{6,7}\)', "EMP_ID", None, "(", icase=False, needs="digit"),
        _d("EMP_ID_ADD_REMOVE", r'\b(?:add|remove|adding|removing)\s+[12]\d{6}\b', "EMP_ID", None, "add", "remov", needs="digit"),
        _d("EMP_ID_ASSIGN", r'\b[12]\d{6}\s+assign\b', "EMP_ID", None, "assign", needs="digit"),
        _d("EMP_ID_ASSIGNED_TO", r'assigned\s+to\s+[12]\d{6}\b', "EMP_ID", None, "assigned", needs="digit"),
        _d("EMP_ID_ASSOCIATE", r'\bassociate\s*\(\s*[12]\d{6}\b', "EMP_ID", None, "associate", needs="digit"),
        _d("EMP_ID_HYPHEN", r'(?:tcs|assign(?:ed)?(?:\s+to)?)\s*[-:]\s*[12]\d{6}\b', "EMP_ID", None, "tcs", "assign", needs="digit"),
        _d("EMP_ID_WORD_HYPHEN", r'(?!(?:rfc|cr|pr)\s*-)[a-z]+\s*-\s*[12]\d{6}\b', "EMP_ID", None, "-", needs="digit"),
        _d("EMP_ID_PORTUGUESE", r'\b(?:associad[oa]|asociado)\s+[A-Za-z]+(?:\s+[A-Za-z]+){0,3},?\s*[12]\d{6}\b', "EMP_ID", None, "associad", "asociado", needs="digit"),
        _d("EMP_ID_THIS_IS", r'this\s+is\s+[A-Za-z]+(?:\s+[A-Za-z]+){0,2},?\s*[12]\d{6}\b', "EMP_ID", None, "this", needs="digit"),
        _d("EMP_ID_CJK", r'[\u4e00-\u9fff]+:\s*[12]\d{6}\b', "EMP_ID", None, ":", icase=False, needs="digit"),
        _d("EMP_ID_LDAP", r'\bCN=[12]\d{6}\b', "EMP_ID", "LDAP", "cn=", needs="digit"),
        _d("EMP_ID_LABELED_EXPLICIT", r'\b(?:emp(?:loyee)?[\s._-]*(?:id|no|number)?|eid)[\s._:=-]+(\d{4,8})\b', "EMP_ID", None, "emp", "eid", needs="digit"),
        _d("EMP_ID_WITH_LABEL", r'(?:with\s+)?emp(?:loyee)?[\s._-]*id[\s._:=-]+(\d{4,8})(?:\s*\([^)]+\))?', "EMP_ID", None, "emp", needs="digit"),
        _d("EMP_ID_AFTER_ASSET", r'(?:\[ASSET_ID\]|\[SERIAL\]|password)\s*[\t\s]+(\d{4,8})\b', "EMP_ID", None, "[asset_id]", "[serial]", "password", icase=False, needs="digit"),
        _d("EMP_ID_SPANISH_CONTEXT", r'(?:equipo|usuario|cuenta|asociado)\s+[^.]{0,50}?\s+(\d{6,7})\b', "EMP_ID", None, "equipo", "usuario", "cuenta", "asociado", needs="digit"),
        _d("EMP_ID_USER_LABELED", r'\b(?:user[\s._-]*(?:id)?|uid|id)[\s._:=-]+(\d{4,8})\b', "EMP_ID", None, "user", "id", needs="digit"),
        _d("EMP_ID_UPN_NUMERIC", r'\b(\d{4,8})@(?:tcs|tcsapps|tcsappsdev|tcscomprod|tata|tataconsultancy)(?:(?:\.(?!com\b)[a-z]++)*+\.com\b)++', "EMP_ID", None, "@", needs="digit"),
        _d("EMP_ID_UPN_PREFIXED", r'\b(?:ad|iada|cad|ws|pr|sa|oth|vo|da|di)\.(\d{4,8})@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', "EMP_ID", None, "@", needs="digit"),
        _d("EMP_ID_UPN_GENERAL", r'\b[a-z]{1,5}\.(\d{4,8})@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', "EMP_ID", None, "@", needs="digit"),
        _d("EMP_ID_PREFIXED_EXTENDED", r'\b(?:ad|iada|cad|ws|pr|sa|oth|vo|da|di)\.(\d{4,8})\b', "EMP_ID", None, ".", needs="digit"),
        _d("EMP_ID_TEAMS_HASH", r'\bteams\s*#\s*(\d{5,7})\b', "EMP_ID", "TEAMS", "teams", needs="digit"),
        _d("EMP_ID_ACCOUNT_OP", r'(?:unlock|enable|disable|activate|deactivate|reset)\s+(?:my\s+)?(?:ad\s+)?account\s+(\d{5,7})\b', "EMP_ID", None, "account", needs="digit"),
        _d("EMP_ID_EMP_HASH_SPACE", r'\bemp\s*#\s*(\d{5,7})\b', "EMP_ID", None, "emp", needs="digit"),
        _d("EMP_ID_HYPHEN_NAME", r'\b(\d{6,7})-(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b', "EMP_ID", None, "-", icase=False, needs="digit"),
        _d("EMP_ID_HYPHEN_NAME_NAME", r'\b\d{6,7}-([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b', "NAME", None, "-", icase=False, needs="digit"),
    )),
    Family("DET11", 6, "redact_emp_ids", "regex_context", 0.9, (
        _d("EMP_ID_SCORED", r'\b(?:2\d{7}|\d{4,7})\b', "EMP_ID", icase=False, needs="digit"),
    )),
    Family("DET12", 7, "redact_asset_ids", "regex", 1.0, (
        _d("ASSET_ID", r'\b\d{2}(?:HWCL|HW|SW|VD|VS|AD|NL|WH|AC)\d{4,}\b', "ASSET_ID", needs="digit"),
        _d("ASSET_ID_EXTENDED", r'\b(?:[0O]\d{1}(?:HW|SW|VD|VS|AD|NL|WH|AC)\d{6,8}|\d{2}(?:HW|SW|VD|VS)[A-Z]{2}\d{5,7})\b', "ASSET_ID", needs="digit"),
        _d("SERIAL_NUMBER", r'\b(?:S/?N|Serial(?:\s*(?:No|Number|#))?)\s*[:\s]\s*([A-Z0-9]{8,20})\b', "SERIAL", tokens=("sn", "n", "serial", "serialno", "serialnumber",)),
    )),
    Family("DET13", 7, "redact_asset_ids", "regex", 0.95, (
        _d("RFID_EPC_TAG", r'\b[0-9A-F]{24}\b', "RFID_TAG", needs="hex"),
        _d("RFID_LABELED", r'(?:barcode|rfid|epc|tag|chip)[\s._-]*(?:id|tag|no)?[\s.:_()=-]*([0-9A-Fa-f]{20,32})', "RFID_TAG", None, "barcode", "rfid", "epc", "tag", "chip", needs="hex"),
    )),
    Family("DET14", 8, "redact_ip_addresses", "regex", 1.0, (
        _d("MAC", r'\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b', "MAC", None, ":", "-", icase=False),
        _d("IPV4", r'\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?::\d{2,5})?\b', "IP", "V4", ".", icase=False, needs="digit"),
        _d("IPV6", r'\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b', "IP", "V6", ":", icase=False),
    )),
    Family("DET15", 9, "redact_hostnames", "regex", 1.0, (
        _d("HOSTNAME", r'\b[A-Z]{2}\d{2}[A-Z]{3}\d{8,}\b', "HOSTNAME", "SVR", needs="digit"),
        _d("HOSTNAME_GENERIC", r'\b[A-Z]{2,4}[A-Z0-9]{2,}(?:DB|SVR|SRV|APP|WEB|PRI|SEC|BAK|PRD|DEV|UAT|QA)\d*\b', "HOSTNAME", "GENERIC", needs="role"),
        _d("HOSTNAME_DB", r'\b[A-Z]{2,6}DB\d{1,4}\b', "HOSTNAME", "DB", "db", needs="digit"),
        _d("HOSTNAME_MEDIA_SERVER", r'(?:media\s*server|backup\s*server|client)\s+([A-Z]{2,}[A-Z0-9]+(?:DB|SRV|PRI|SEC)?\d*)\b', "HOSTNAME", "MEDIA", "server", "client"),
    )),
    Family("DET16", 9, "redact_hostnames", "regex", 1.0, (
        _d("FQDN_INTERNAL", r'\b([a-zA-Z][a-zA-Z0-9-]{0,62}+(?:\.[a-zA-Z][a-zA-Z0-9-]{0,62}+(?:\.(?!(?:local|internal|corp|lan|intra|private|home)\b)[a-zA-Z][a-zA-Z0-9-]{0,62}+)*+(?=\.(?:local|internal|corp|lan|intra|private|home)\b))++\.(?:local|internal|corp|lan|intra|private|home))\b', "HOSTNAME", "INTERNAL", ".local", ".internal", ".corp", ".lan", ".intra", ".private", ".home", needs="dot"),
        _d("FQDN_LABELED", r'(?:server|host|hostname|fqdn|machine|node)[\s:=-]+([a-zA-Z][a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b', "HOSTNAME", "FQDN", "server", "host", "fqdn", "machine", "node", needs="dot"),
        _d("FQDN", r'(?<![@:/])\b(?!www\.)([a-zA-Z][a-zA-Z0-9-]{0,62}+(?:\.[a-zA-Z][a-zA-Z0-9-]{0,62}+(?:\.(?![a-zA-Z][a-zA-Z0-9-]{0,62}\b(?!@))[a-zA-Z][a-zA-Z0-9-]{0,62}+)*+(?=\.[a-zA-Z][a-zA-Z0-9-]{0,62}\b(?!@)))++\.[a-zA-Z][a-zA-Z0-9-]{0,62})\b(?![@])', "HOSTNAME", "FQDN", needs="dot"),
    )),
    Family("DET17", 10, "redact_ticket_ids", "itsm", 0.95, (
        _d("SERVICENOW_TICKET", r'\b(?:INC|RITM|REQ|CHG|PRB|TASK|SCTASK|KB|STRY|CTASK)(\d{7,10})\b', "TICKET_NUM", needs="digit"),
        _d("JIRA_TICKET", r'\b[A-Z]{2,10}-\d{1,6}\b', "TICKET", None, "-", needs="digit"),
        _d("TICKET_LABELED", r'\b(?:ticket|incident|request|case|issue|sr|service\s*request)[\s#:_-]*(?:no|number|id)?[\s#:_-]*([A-Za-z]*\d{5,12})\b', "TICKET_NUM", None, "ticket", "incident", "request", "case", "issue", "sr", needs="digit"),
        _d("RFC_NUMBER", r'\bRFC\s*(?:#|No[:\s.]*|\s*[-:]\s*)\d{7,10}\b', "RFC", None, "rfc", needs="digit"),
        _d("RFC_NUMBER_SIMPLE", r'\bRFC\s+\d{7,10}\b', "RFC", None, "rfc", needs="digit"),
        _d("RFC_CONTEXTUAL", r'(?:as\s+per|refer(?:ence)?|see|per|for|regarding)\s+(?:RFC\s*(?:num(?:ber)?|no\.?)?|RFC)\s*:?\s*(\d{7,10})\b', "RFC", None, "rfc", needs="digit"),
        _d("RFC_NUM_LABELED", r'\bRFC\s+(?:num(?:ber)?|no\.?)\s*:?\s*(\d{7,10})\b', "RFC", None, "rfc", needs="digit"),
        _d("RFC_STANDALONE_CONTEXT", r'(?:install|update|upgrade|configure|deploy|rollout|provision)[\w\s,]+,\s*(\d{7,8})\b', "RFC", None, "install", "update", "upgrade", "configure", "deploy", "rollout", "provision", needs="digit"),
        _d("RFC_PREFIX_FORMAT", r'\b(\d{7,8})-[A-Za-z][\w\s]+\b', "RFC", None, "-", icase=False, needs="digit"),
        _d("CR_NUMBER", r'\bCR\s*(?:#|No[:\s.]*|[-:])\s*\d{6,10}\b', "CR", None, "cr", needs="digit"),
        _d("ARIBA_PR", r'\bPR\s*[:\-]?\s*\d{6,8}\b', "PR", None, "pr", needs="digit"),
        _d("TICKET_EXTENDED", r'\bTicket\.?\s*No\.?\s*:?\s*\d{8,12}\b', "TICKET_NUM", None, "ticket", needs="digit"),
        _d("CS_TICKET_LABELED", r'(?:CS|Customer\s*Service)[\s_-]*(?:ticket|case|incident)?[\s:_#-]*(?:no|number|id)?[\s:_#-]*(\d{8,12})', "TICKET_NUM", None, "cs", "customer", needs="digit"),
        _d("TICKET_NUMBER_LABELED", r'(?:ticket|case|incident)[\s_-]*(?:no|number|id)[\s:_#-]*(\d{7,12})', "TICKET_NUM", None, "ticket", "case", "incident", needs="digit"),
    )),
    Family("DET18", 10, "redact_ticket_ids", "itsm", 0.95, (
        _d("SECURITY_INCIDENT", r'\bES\d{5,8}\b', "INCIDENT_ID", None, "es", needs="digit"),
        _d("SECURITY_INCIDENT_LABELED", r'(?:security\s+incident|investigation|alert|case)\s*[\s.:_#-]*([A-Z]{2,4}\d{5,10})', "INCIDENT_ID", None, "incident", "investigation", "alert", "case", needs="digit"),
    )),
    Family("DET19", 10, "redact_remote_access_ids", "remote_access", 0.90, (
        _d("TEAMVIEWER_ID", r'(?:teamviewer|tv)[\s:_-]*(?:id)?[\s:_-]*(\d{3}[\s-]?\d{3}[\s-]?\d{3,4})\b', "REMOTE_ID", None, "teamviewer", "tv", needs="digit"),
        _d("ANYDESK_ID", r'(?:anydesk)[\s:_-]*(?:id)?[\s:_-]*(\d{3}[\s-]?\d{3}[\s-]?\d{3})\b', "REMOTE_ID", None, "anydesk", needs="digit"),
        _d("REMOTE_ID_LABELED", r'(?:remote[\s_-]*(?:id|access)|rdp[\s_-]*(?:id)?|vnc[\s_-]*(?:id)?)[\s:_-]*([A-Za-z0-9._-]{5,30})\b', "REMOTE_ID", None, "remote", "rdp", "vnc"),
    )),
    Family("DET20", 10, "redact_cloud_ids", "cloud", 0.95, (
        _d("AZURE_SUBSCRIPTION", r'(?:subscription|sub)[\s:_-]*(?:id)?[\s:_-]*([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})\b', "AZURE_SUB", None, "-"),
        _d("AZURE_RESOURCE_ID", r'/subscriptions/[a-f0-9-]{36}/resourceGroups/[^/]+/providers/[^\s]+', "AZURE_RESOURCE", None, "/subscriptions/", needs="slash"),
        _d("AWS_ACCOUNT_ID", r'(?:aws|amazon)[\s_-]*(?:account)?[\s_-]*(?:id)?[\s:_-]*(\d{12})\b', "AWS_ACCOUNT", None, "aws", "amazon", needs="digit"),
        _d("AWS_ARN", r'\barn:aws:[a-z0-9-]+:[a-z0-9-]*:\d{12}:[^\s]+\b', "AWS_ARN", None, "arn:aws:", needs="digit"),
        _d("GCP_PROJECT", r'(?:gcp|google\s*cloud)[\s_-]*(?:project)?[\s_-]*(?:id)?[\s:_-]*([a-z][a-z0-9-]{4,28}[a-z0-9])\b', "GCP_PROJECT", None, "gcp", "google"),
    )),
    Family("DET21", 11, None, "regex", 1.0, (
        _d("UPI", r'\b[a-zA-Z0-9._-]{2,}@(?:upi|paytm|gpay|phonepe|ybl|okhdfcbank|okaxis|oksbi|okicici|okboi|apl|axl|ibl|ikwik|freecharge|airtel|jio|mobikwik|amazonpay|slice)\b', "UPI", needs="at"),
    )),
    Family("DET22", 11, "redact_banking", "regex", 1.0, (
        _d("BANK_ACCOUNT_IN", r'\b(?:a/?c|account|acct)[\s.:_-]*(?:no|number|num|#)?[\s.:_-]*\d{9,18}\b', "BANK_ACCOUNT", "IN", "a/c", "ac", needs="digit"),
        _d("BANK_ACCOUNT_CONTEXTUAL", r'(?:transfer(?:\s+to)?|deposit(?:\s+(?:to|into))?|credit(?:\s+to)?|debit(?:\s+from)?|send(?:\s+to)?|pay(?:\s+to)?|beneficiary|payee)[\s.:_#-]*(?:a/?c|account|acct)?[\s.:_#-]*(?:no|number|num|#)?[\s.:_#-]*\d{9,18}\b', "BANK_ACCOUNT", "IN", "transfer", "deposit", "credit", "debit", "send", "pay", "beneficiary", needs="digit"),
        _d("IFSC", r'\b[A-Z]{4}0[A-Z0-9]{6}\b', "IFSC", None, "0", needs="digit"),
        _d("IBAN", r'\b[A-Z]{2}\d{2}\s?[A-Z0-9]{4}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b', "IBAN", needs="digit"),
        _d("SWIFT", r'(?:swift|bic|swift\s*code|bic\s*code)[\s.:_#-]*[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b', "SWIFT", None, "swift", "bic"),
        _d("ROUTING_NUMBER", r'(?:routing|aba|transit)[\s.:_#-]*(?:no|number|num|#)?[\s.:_#-]*\d{9}\b', "ROUTING_NUM", None, "routing", "aba", "transit", needs="digit"),
    )),
    Family("DET23", 11, "redact_financial", "regex", 1.0, (
        _d("CREDIT_CARD", r'\b(?:\d{4}[\s-]?){3}\d{4}\b', "CARD", icase=False, needs="digit"),
        _d("EPF_UAN", r'(?:uan|epf|pf)[\s.:_#-]*(?:no|number|#)?[\s.:_#-]*\d{12}\b', "EPF_UAN", None, "uan", "pf", needs="digit"),
        _d("EPF_MEMBER_ID", r'\b[A-Z]{2}[\s/]?[A-Z]{3}[\s/]?\d{7}[\s/]?\d{3}[\s/]?\d{7}\b', "EPF_ID", needs="digit"),
        _d("INSURANCE_POLICY", r'(?:policy|insurance)[\s.:_#-]*(?:no|number|num|id|#)?[\s.:_#-]*[A-Z0-9]{2,5}[-/]?[A-Z0-9]{5,15}\b', "INSURANCE_POLICY", None, "policy", "insurance"),
    )),
    Family("DET24", 11, "redact_dob", "regex", 0.9, (
        _d("DOB", r'\b(?:dob|date\s*of\s*birth|birth\s*date|born\s*(?:on)?)[\s.:_-]*(?:is\s*)?\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b', "DOB", None, "dob", "birth", "born", needs="digit"),
        _d("AGE", r'\b(?:age)[\s.:_-]*(?:is\s*)?\d{1,3}\s*(?:years?|yrs?|y/?o)?\b', "AGE", None, "age", needs="digit"),
    )),
    Family("DET25", 12, "redact_active_directory", "active_directory", 0.95, (
        _d("LDAP_DN", r'\b(?:CN|OU|DC|UID)=[^,\s]++(?:,\s*+(?:CN|OU|DC|UID)=[^,\s]++)++', "AD_NAME", tokens=("cn", "ou", "dc", "uid",)),
        _d("SAM_ACCOUNT", r'\b[A-Za-z][A-Za-z0-9_-]{2,20}\\([A-Za-z][A-Za-z0-9._-]{2,30})\b', "AD_USER", None, icase=False, needs="backslash"),
        _d("WINDOWS_SID", r'\bS-1-\d{1,2}(?:-\d+){1,14}\b', "SID", None, "s-1-", icase=False, needs="digit"),
        _d("AD_UPN", r'\b[A-Za-z][A-Za-z0-9._-]+@[A-Za-z0-9-]+\.(?:local|internal|corp|ad|domain)\b', "AD_UPN", needs="at"),
        _d("SERVICE_ACCOUNT_PREFIXED", r'\b(?:sa|svc|oth|srv|app)\.[a-zA-Z0-9._-]+\b', "SERVICE_ACCT", None, "sa.", "svc.", "oth.", "srv.", "app.", needs="dot"),
        _d("SERVICE_ACCOUNT_NT", r'\bNT\d{4,8}\b', "SERVICE_ACCT", None, "nt", needs="digit"),
        _d("SERVICE_ACCOUNT_GENERIC", r'\bsa\d{6,10}[a-z]*\b', "SERVICE_ACCT", None, "sa", needs="digit"),
    )),
    Family("DET26", 13, None, "regex", 0.9, (
        _d("WIN_PATH", r'[A-Z]:\\Users\\([^\\\s]+)', "USERNAME", None, ":\\users\\", span=FIRST, needs="backslash"),
    )),
    Family("DET27", 13, "redact_workplace_info", "workplace", 0.85, (
        _d("LOCATION_WING_ID", r'\b[A-Z]{2,5}\d?/(?:\d/)?(?:ODC\d?|WING[-\w]*)/(?:WSN/)?\d+\b', "LOCATION", None, "/", needs="digit"),
        _d("SEAT_EXTENDED", r'\b(?:S\d+-\d+F-Z\d+-\d+|\d{1,2}F\s+ODC\s+\d+)\b', "SEAT", needs="digit"),
        _d("SEAT_AT_LOCATION", r'@[A-Z]{2,5}\s*[A-Z]?\d{1,3}(?:\s*,?\s*(?:Seat\s*(?:No\.?|Number)?\s*\d{1,4}))?', "LOCATION", None, "@", needs="digit"),
        _d("SEAT_NUMBER_LABELED", r'\b(?:Seat|Desk|Cubicle|Bay|Pod)\s*(?:No\.?|Number|#)?\s*:?\s*\d{1,4}\b', "SEAT", None, "seat", "desk", "cubicle", "bay", "pod", needs="digit"),
        _d("LOCATION_UNDERSCORE_ODC", r'\b[A-Z]{2,4}\d?_(?:(?!(?:ODC\d*+|[A-Z]?\d++F)(?=_|\b))[A-Z0-9]{1,4}+_)*+(?=(?:ODC\d*+|[A-Z]?\d++F)(?=_|\b))(?:[A-Z0-9]{1,4}+_(?:(?!(?:ODC\d*+|[A-Z]?\d++F)(?=_|\b))[A-Z0-9]{1,4}+_)*+(?=(?:ODC\d*+|[A-Z]?\d++F)(?=_|\b)))*+(?:ODC\d*+|[A-Z]?\d++F)(?:_[A-Z0-9]++)*+\b', "LOCATION", None, "_"),
        _d("LOCATION_UNDERSCORE_TOWER", r'\b(?:IND|USA|UK|EUR|APAC|EMEA|BLR|CHN|HYD|MUM|PUN|DEL)_[A-Z]{2,5}_[A-Z]{2,5}_[A-Z]?\d+(?:_[A-Z0-9_]+)?\b', "LOCATION", None, "_", needs="digit"),
        _d("LOCATION_FLOOR_PATTERN", r'\b[A-Z]{2,4}\d?_\d{1,2}F_[A-Z0-9]+\b', "LOCATION", None, "_", needs="digit"),
        _d("ORG_SEAT_PATTERN", r'\b([A-Za-z]\d{1,2}[Ff][\s-]?\d{2,3})\b', "SEAT", None, "f", needs="digit"),
        _d("DESK_LOCATION", r'\b(?:desk|seat|cubicle|workstation|bay|pod)[\s#:_-]*([A-Z]?\d{1,4}[A-Z]?)\b', "DESK_NUM", None, "desk", "seat", "cubicle", "workstation", "bay", "pod", needs="digit"),
        _d("FLOOR_LOCATION", r'\b(?:floor|flr|level|building|bldg|block|wing)[\s#:_-]*(\d{1,3}[A-Z]?)\s*(?:,?\s*(?:desk|seat|cubicle)?[\s#:_-]*[A-Z]?\d{1,4}[A-Z]?)?\b', "LOCATION_NUM", None, "floor", "flr", "level", "building", "bldg", "block", "wing", needs="digit"),
        _d("BADGE_NUMBER", r'\b(?:badge|card|access\s*card|id\s*card|employee\s*card)[\s#:_-]*(?:no|number|id)?[\s#:_-]*(\d{4,10})\b', "BADGE_NUM", None, "badge", "card", needs="digit"),
        _d("PHONE_EXTENSION", r'\b(?:ext(?:ension)?|extn|x)[\s.:_-]*(\d{3,5})\b', "EXT", None, "x", needs="digit"),
        _d("DID_NUMBER", r'\b(?:did|direct\s*(?:dial|line))[\s:_-]*(\+?\d[\d\s-]{7,15})\b', "DID", None, "did", "direct", needs="digit"),
        _d("INTERNAL_DOMAIN", r'\b(?:India\.tcs\.com|(?:SOAM|NOAM|GLOBE|APAC|EMEA|LATAM|AMEA)(?:\.tcs\.com)?)\b', "DOMAIN", tokens=("india", "soam", "noam", "globe", "apac", "emea", "latam", "amea",)),
    )),
    Family("DET28", 13, "redact_chat_handles", "chat", 0.80, (
        _d("CHAT_MENTION", r'@([A-Za-z][A-Za-z0-9._-]{2,30})\b', "CHAT_USER", icase=False, needs="at"),
        _d("CHAT_DM", r'(?:dm|direct\s*message|private\s*(?:chat|message))[\s:_-]*(?:with|to|from)?[\s:_-]*([A-Za-z][A-Za-z0-9._\s-]{2,40})\b', "CHAT_USER", None, "dm", "direct", "private"),
    )),
    Family("DET29", 13, "redact_audit_info", "audit", 0.85, (
        _d("AUDIT_USER_ACTION", r'\b(?:user|account)\s+([A-Za-z][A-Za-z0-9._-]+)\s+(?:logged\s*in|logged\s*out|signed\s*in|signed\s*out|accessed|modified|deleted|created|updated)\b', "AUDIT_USER", tokens=("user", "account",)),
        _d("LOGIN_EVENT", r'(?:login|logon|sign[\s-]*in|authentication)\s+(?:for|by|from|as)\s+(?:user\s+)?([A-Za-z][A-Za-z0-9._@\\-]+)\b', "LOGIN_USER", None, "login", "logon", "sign", "auth"),
    )),
    Family("NAM2", 15, "redact_names", "pattern", 0.8, (
        _d("NAME_WITH_TITLE", r'\b(?:[Mm][Rr]|[Mm][Ss]|[Mm][Rr][Ss]|[Dd][Rr]|[Ss][Hh][Rr][Ii]|[Ss][Mm][Tt]|[Ss][Rr][Ii])\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b', "NAME", span=LEAD, icase=False,
           head=r"(?=[MmDdSs][RrSsHhMm])(?<![A-Za-z0-9_])", tokens=("mr", "ms", "mrs", "dr", "shri", "smt", "sri",)),
        _d("NAME_LABELED", r'(?<!domain\s)(?<!host\s)(?<!server\s)(?<!machine\s)(?<!file\s)(?<!folder\s)(?<!computer\s)(?<!device\s)\b(?:name|contact|user|employee|emp)[\s]*[:\-]\s*([A-Za-z]+(?:\s+[A-Za-z]+){0,3})', "NAME", span=FIRST, tokens=("name", "contact", "user", "employee", "emp",)),
        _d("MY_NAME_IS", r'\bmy name is\s+([A-Za-z]+(?:\s+[A-Za-z]+){0,2})', "NAME", span=FIRST, tokens=("my",)),
        _d("NAME_AFTER_EMP_ID", r'\d{6,7}\(([A-Za-z][A-Za-z\s]{2,25})\)', "NAME", None, "(", needs="digit"),
    )),
    Family("NAM3", 16, "redact_names", "context", 0.95, (
        _d("NAME_CONTEXT_FROM_BY", r'\b(?:from|by|cc|bcc|sent (?:by|to)|created by|assigned to|resolved by|(?:updated|approved|rejected|replied|reported|submitted) by|forwarded (?:by|to)|escalated to|transferred to|delegated to|delivered to|addressed to|directed to|(?:email|emailed|message) to)[\s:]+([A-Za-z]+(?:\s+[A-Za-z]+){0,2})', "NAME",
           head=r"(?=(?-i:[FfBbCcSsAaRrUuEeTtDdMm][rRyYcCeEsSpPuUoOdDmMiI]))(?<![A-Za-z0-9_])", tokens=("from", "by", "cc", "bcc", "to",)),
        _d("NAME_GREETING", r'\b(?:hi|hello|dear|hey|good\s*(?:morning|afternoon|evening))[\s,]+([A-Za-z]+)(?:[\s,]|$)', "NAME",
           head=r"(?=(?-i:[HhDdGg][IiEeOo]))(?<![A-Za-z0-9_])", tokens=("hi", "hello", "dear", "hey", "good", "goodmorning", "goodafternoon", "goodevening",)),
        _d("NAME_COMMUNICATION", r'\b(?:spoke\s+(?:to|with)|contacted|emailed|messaged|reached\s+out\s+to|got\s+in\s+touch\s+with|heard\s+from|response\s+from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)', "NAME", tokens=("spoke", "contacted", "emailed", "messaged", "reached", "got", "heard", "response",)),
        _d("NAME_TICKET_CALLER", r'\b(?:caller|affected\s*user|end\s*user|requestor|requester|raised\s*by|logged\s*by|opened\s*by|closed\s*by|ticket\s*owner|incident\s*owner|case\s*owner)[\s:]+([A-Za-z]+(?:\s+[A-Za-z]+){0,2})', "NAME", tokens=("caller", "affected", "affecteduser", "end", "enduser", "requestor", "requester", "raised", "raisedby", "logged", "loggedby", "opened", "openedby", "closed", "closedby", "ticket", "ticketowner", "incident", "incidentowner", "case", "caseowner",)),
        _d("NAME_USER_ACTION", r'\buser\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)\s+(?:reported|raised|logged|called|mentioned|confirmed|requested)', "NAME", tokens=("user",)),
        _d("NAME_HAS_ACTION", r'\b([A-Za-z]+(?:\s+[A-Za-z]+)?)\s+has\s+(?:reported|raised|logged|called|requested|confirmed|approved)', "NAME", tokens=("has",)),
        _d("NAME_WITH_PARENS", r'\b([A-Za-z]+(?:\s+[A-Za-z]+){1,2})\s*\([^)]+\)', "NAME", None, "("),
        _d("NAME_SIGNATURE_LINE", r'(?m)(?:^|\n)\s*[-–—]{1,2}\s*([A-Za-z]+(?:\s+[A-Za-z]+)?)', "NAME", None, "-", "–", "—"),
        _d("NAME_AFTER_SIGNATURE", r'(?:thanks?|thank\s*you|regards?|best(?:\s*regards?)?|warm(?:\s*regards?)?|sincerely|cheers)[,\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*(?:[,\n]|$|[\[\(])', "NAME", None, "thank", "regard", "best", "warm", "sincerely", "cheers"),
    )),
    Family("NAM4", 17, "redact_names", "email_correlation", 0.90, (
        _d("NAME_NEAR_EMAIL", "", "NAME", needs="at"),
    )),
    Family("NAM5", 18, "redact_names", "dictionary", 0.75, (
        _d("CAPITALISED_NAME", r'\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b', "NAME", icase=False, needs="capitals"),
        _d("UPPER_NAME", r'\b([A-Z]{2,}(?:\s+[A-Z]{2,}){1,2})\b', "NAME", icase=False, needs="capitals"),
        _d("SINGLE_NAME", r'\b(?:dear|hello|hi|hey|mr|mrs|ms|dr|prof|contact|call|email|notify|attn|cc)[\s,.]+([A-Z][a-z]+)\b', "NAME",
           head=r"(?=(?-i:[DdHhMmPpCcEeNnAa][EeIiRrSsOoAaMmTtCc]))(?<![A-Za-z0-9_])", tokens=("dear", "hello", "hi", "hey", "mr", "mrs", "ms", "dr", "prof", "contact", "call", "email", "notify", "attn", "cc",)),
    )),
)

# Fixed value: closing formulas. The look-ahead only makes other words fail fast.
SIGNATURE_START = (
    r"(?=(?-i:[TtRrBbWwSsCc][HhEeAaIi]))(?<![A-Za-z0-9_])"
    r"\b(?:thanks?(?:\s{0,5}(?:and|&)\s{0,5}regards?)?|thank\s{0,5}you|regards?|best(?:\s{0,5}regards?)?"
    r"|warm(?:\s{0,5}regards?)?|sincerely|cheers)\b"
)

# What the second pass looks for in text that already holds tokens.
CLEANUP: tuple[Detector, ...] = (
    _d("EMP_ID_AFTER_TOKEN", r'\[(?:EMP_ID|NAME|EMAIL|PHONE)\]\s*[#:,\t\s]+(\d{5,7})\b', "EMP_ID", icase=False),
    _d("NAME_AFTER_TOKEN", r'\[(?:EMP_ID|NAME|EMAIL)\]\s*[\t,;|]+\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})(?=\s*[,\t\n|]|\s*$)', "NAME", icase=False),
    _d("ADJACENT_NAME", r'\[NAME\]\s+([A-Z][a-z]{1,20})\b', "NAME", icase=False),
    _d("EMAIL_FRAGMENT", r'\[(?:NAME|EMP_ID)\][._]?([a-zA-Z0-9._+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', "EMAIL", icase=False),
)

CN_VALUE = r"CN=([^,]+)"


@dataclass(frozen=True)
class Row:
    """A detector with its place in the order and its family's provenance."""

    ordinal: int
    family: Family
    detector: Detector

    @property
    def name(self) -> str:
        return self.detector.name


_ENGINE = {"NAM3": "enable_context_rules", "NAM5": "enable_dictionaries"}


def rows(config: RedactionConfig) -> list[Row]:
    """The enabled detectors in order; switched-off ones never reach the plan."""
    entries: list[tuple[int, Family, Detector]] = []
    for family in FAMILIES:
        if family.toggle and not getattr(config, family.toggle):
            continue
        if not getattr(config, _ENGINE.get(family.ident, "enable_regex")):
            continue
        if config.only and family.ident not in config.only:
            continue
        entries += [(family.layer, family, d) for d in family.detectors]
    for custom in config.custom_patterns:
        if not custom.enabled:
            continue
        family = Family("EXT1", custom.layer, None, "custom", 1.0, ())
        kind = custom.token.strip("[]")
        detector = Detector(f"CUSTOM_{custom.name}", custom.pattern, kind, icase=False)
        entries.append((custom.layer, family, detector))
    entries.sort(key=lambda e: e[0])
    return [Row(i, family, d) for i, (_, family, d) in enumerate(entries)]


def all_detectors() -> Iterator[tuple[Family, Detector]]:
    for family in FAMILIES:
        for detector in family.detectors:
            yield family, detector
