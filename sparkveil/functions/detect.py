"""From a text column to findings and redacted text, as one Catalyst expression.

Detection, rules, overlap resolution and splicing are built here as SQL text from the
enabled catalogue rows. The work is cut into stages. Each stage is an expression over a
small state struct ``s``, so that the analyzer never meets a deep expression, and so that
the same stages run over a column, over the elements of an array and over a stream.
Nothing leaves the JVM and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from sparkveil.functions import spans as S
from sparkveil.functions.checks import luhn_sql, verhoeff_sql
from sparkveil.functions.clean import clean_steps, strip_sql, unmark_sql
from sparkveil.functions.sql import any_of, array, let, lit, regex, words
from sparkveil.plans import catalog
from sparkveil.plans import words as W
from sparkveil.plans.catalog import Row
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.tokens import token
from sparkveil.plans.words import NameLists

FINDING = (
    "struct<original:string,replacement:string,pi_type:string,start:int,end:int,"
    "confidence:double,method:string>"
)


ORIGINAL = "IF(c.e - c.s = length(c.v), c.v, concat(c.lead, c.v))"
"""The text of span ``c``; it is carried along, so the text need not be walked again."""


class Plan:
    """The expressions for one config and one set of name lists."""

    def __init__(self, config: RedactionConfig | None = None, names: NameLists | None = None) -> None:
        self.config = config or RedactionConfig()
        self.names = names or NameLists()
        self.rows = catalog.rows(self.config)
        self.at = {r.name: r.ordinal for r in self.rows}

    # -- tokens ---------------------------------------------------------------

    def _static(self, values: Sequence[str]) -> str:
        return f"element_at({array(values)}, c.o + 1)"

    def _texts(self) -> list[str]:
        c = self.config
        return [
            ("CN=" if r.name == "EMP_ID_LDAP" else "")
            + (self._custom_token(r) if r.family.ident == "EXT1" else token(c, r.detector.kind, r.detector.sub))
            for r in self.rows
        ] or [""]

    def token_sql(self) -> str:
        """The token of span ``c``."""
        c = self.config
        texts = self._texts()
        cases = []
        if "EMAIL" in self.at:
            local, domain = "substring_index(lower(c.v), '@', 1)", "substring_index(lower(c.v), '@', -1)"
            prefix = f"substring_index({local}, '.', 1)"
            rest = f"substring({local}, length({prefix}) + 2)"
            cases.append(
                f"WHEN c.o = {self.at['EMAIL']} AND {local} RLIKE '^[0-9]{{4,7}}$' "
                f"AND {domain} IN ({words(W.EMPLOYEE_DOMAINS)}) THEN '[EMP_ID]@[DOMAIN]'"
            )
            cases.append(
                f"WHEN c.o = {self.at['EMAIL']} AND {prefix} IN ({words(W.ACCOUNT_PREFIXES)}) "
                f"AND {rest} RLIKE '^[0-9]{{4,7}}$' THEN concat(upper({prefix}), '.[EMP_ID]@[DOMAIN]')"
            )
        if "EMP_ID_PREFIXED" in self.at and c.use_typed_tokens and c.use_granular_tokens:
            cases.append(
                f"WHEN c.o = {self.at['EMP_ID_PREFIXED']} THEN "
                "concat('[EMP_ID_', upper(substring_index(c.v, '.', 1)), ']')"
            )
        static = self._static(texts)
        return f"CASE {' '.join(cases)} ELSE {static} END" if cases else static

    def _custom_token(self, row: Row) -> str:
        name = row.name.removeprefix("CUSTOM_")
        custom = next(p for p in self.config.custom_patterns if p.name == name)
        return custom.token if self.config.use_typed_tokens else self.config.replacement_token

    def _mixed(self) -> bool:
        """Whether the type of a span may hang on its token."""
        return "EMAIL" in self.at or any(x.endswith("[EMP_ID]@[DOMAIN]") for x in self._texts())

    def type_sql(self) -> str:
        """The clean type name of span ``c``."""
        plain = self.config.with_(use_typed_tokens=True)
        kinds = [token(plain, r.detector.kind, r.detector.sub).strip("[]") for r in self.rows] or [""]
        cases = ""
        if self._mixed():
            cases = "WHEN endswith(c.tok, '[EMP_ID]@[DOMAIN]') THEN 'EMP_ID' "
        if "EMP_ID_PREFIXED" in self.at and self.config.use_granular_tokens:
            cases += (
                f"WHEN c.o = {self.at['EMP_ID_PREFIXED']} THEN "
                "concat('EMP_ID_', upper(substring_index(c.v, '.', 1))) "
            )
        return f"CASE {cases}ELSE {self._static(kinds)} END" if cases else self._static(kinds)

    # -- rules ----------------------------------------------------------------

    def _rules(self) -> dict[str, str]:
        """Extra conditions on span ``c``, by detector."""
        cfg = self.config
        value, domain = "lower(c.v)", "substring_index(lower(c.v), '@', -1)"
        digits = "regexp_replace(c.v, '[\\\\s-]', '')"
        before50 = "lower(substring(s.t, greatest(c.s - 49, 1), c.s - greatest(c.s - 50, 0)))"
        title_words = f"exists(split({value}, '\\\\s+'), w -> w IN ({words(W.NOT_A_TITLED_NAME)}))"
        public = f"exists({array(W.PUBLIC_DOMAINS)}, d -> {value} = d OR endswith({value}, concat('.', d)))"
        rules = {
            "PASSWORD": f"trim(TRAILING '.,;:!?' FROM {value}) NOT IN ({words(W.NOT_A_CREDENTIAL)})",
            "AADHAAR": f"{verhoeff_sql(digits)} OR {any_of(before50, W.AADHAAR_KEYWORDS)}",
            "FQDN_LABELED": f"{value} NOT IN ({words(W.PUBLIC_DOMAINS)})",
            "FQDN": f"NOT {public}",
            "CHAT_MENTION": f"{value} NOT IN ({words(W.CHAT_SKIP)})",
            "NAME_WITH_TITLE": f"NOT {title_words}",
            "NAME_LABELED": f"NOT ({self._shouting('c.v')}) AND NOT {title_words}",
            "NAME_AFTER_EMP_ID": f"length(trim(c.v)) > 2 AND lower(trim(c.v)) NOT IN ({words(W.SYSTEMS)})",
        }
        if cfg.luhn_check:
            rules["CREDIT_CARD"] = luhn_sql(digits)
        excluded = []
        if cfg.excluded_emails:
            excluded.append(f"{value} NOT IN ({words(cfg.excluded_emails)})")
        if cfg.excluded_domains:
            excluded.append(f"{domain} NOT IN ({words(cfg.excluded_domains)})")
        if excluded:
            rules["EMAIL"] = " AND ".join(excluded)
        if cfg.excluded_phones:
            starts = " OR ".join(
                f"startswith(c.v, {lit(p)}) OR startswith(replace(replace(c.v, ' ', ''), '-', ''), {lit(p)})"
                for p in sorted(cfg.excluded_phones)
            )
            rules |= {r.name: f"NOT ({starts})" for r in self.rows if r.family.ident == "DET9"}
        return rules

    @staticmethod
    def _shouting(x: str) -> str:
        return f"{x} RLIKE '[A-Za-z]' AND {x} = upper({x}) AND length({x}) <= 20"

    def rule_sql(self) -> str:
        cases = [f"WHEN {self.at[name]} THEN {rule}" for name, rule in self._rules().items() if name in self.at]
        kept = f"CASE c.o {' '.join(cases)} ELSE TRUE END" if cases else "TRUE"
        if self.config.excluded_terms:
            kept = f"({kept}) AND lower(concat(c.lead, c.v)) NOT IN ({words(self.config.excluded_terms)}) "
            kept += f"AND lower(c.v) NOT IN ({words(self.config.excluded_terms)})"
        return kept

    def passing_sql(self, spans: str) -> str:
        rule = self.rule_sql()
        return spans if rule == "TRUE" else f"filter({spans}, c -> {rule})"

    # -- families that need more than a rule ----------------------------------

    def _ordinals(self, *idents: str) -> list[int]:
        return [r.ordinal for r in self.rows if r.family.ident in idents]

    @staticmethod
    def _between(ordinals: Sequence[int], var: str = "c") -> str:
        return f"{var}.o BETWEEN {min(ordinals)} AND {max(ordinals)}" if ordinals else "FALSE"

    def emails_sql(self) -> str | None:
        """Drop orphan address tails that lie in a kept address."""
        if "EMAIL" not in self.at:
            return None
        full, tail = self.at["EMAIL"], self.at["EMAIL_PARTIAL_LASTNAME"]
        covered = f"exists(filter(s.m, x -> x.o = {full}), r -> r.s <= c.s AND c.s < r.e)"
        return f"IF(exists(s.m, x -> x.o = {tail}), filter(s.m, c -> c.o != {tail} OR NOT {covered}), s.m)"

    def directory_sql(self) -> str | None:
        """Each CN value inside a distinguished name, in place of the whole name."""
        if "LDAP_DN" not in self.at:
            return None
        dn = self.at["LDAP_DN"]
        inner = catalog.Detector("CN", catalog.CN_VALUE, "AD_NAME")
        shifted = (
            f"transform({S.find('c.v', inner, first=dn)}, y -> named_struct('s', y.s + c.s, 'n', y.n, 'o', y.o, "
            "'e', y.e + c.s, 'lead', y.lead, 'v', y.v))"
        )
        parts = f"flatten(transform(filter(s.m, c -> c.o = {dn}), c -> {shifted}))"
        return f"IF(exists(s.m, x -> x.o = {dn}), concat(filter(s.m, c -> c.o != {dn}), {parts}), s.m)"

    def score_sql(self) -> str:
        """How much the surroundings of the number ``c`` speak for an employee number."""
        size = "length(c.v)"
        negative_ends = [k + end for k in W.NEGATIVE_KEYWORDS for end in ("", " ", ":", "#")]
        near = "substring(s.t, greatest(c.s - 4, 1), c.e + 5 - greatest(c.s - 5, 0))"
        near_before = "substring(s.t, greatest(c.s - 4, 1), c.s - greatest(c.s - 5, 0))"
        strong = f"3 * size(filter({array(W.STRONG_KEYWORDS)}, w -> contains(x.ctx, w)))"
        medium = f"least(5, size(filter({array(W.MEDIUM_KEYWORDS)}, w -> contains(x.ctx, w))))"
        negative = " OR ".join(
            [f"exists({array(negative_ends)}, w -> endswith(x.lb, w))"]
            + [f"x.b RLIKE {regex(p)}" for p in W.NEGATIVE_BEFORE]
            + [f"x.a RLIKE {regex(p)}" for p in W.NEGATIVE_AFTER]
        )
        points = " + ".join((
            strong,
            medium,
            f"IF(contains({near}, '\\t'), 2, 0)",
            f"IF(contains({near_before}, '  '), 1, 0)",
            f"IF(x.b RLIKE {regex(r'[A-Z][a-z]+\s*$')}, 2, 0)",
            f"IF(x.b RLIKE {regex(r'[A-Z]{2,}\s*$')}, 2, 0)",
            f"IF(x.a RLIKE {regex(r'^\s*[A-Z][a-z]')}, 1, 0)",
            f"IF(x.b RLIKE {regex(r'\[(?:NAME|ASSET_ID|EMP_ID)\]\s*,?\s*$')}, 3, 0)",
            f"IF(c.s < 15 OR x.b RLIKE {regex(r'[\n\r]\s*$')}, 1, 0)",
            f"CASE {size} WHEN 4 THEN -2 WHEN 5 THEN -1 WHEN 7 THEN 1 ELSE 0 END",
        ))
        context = (
            "named_struct('b', substring(s.t, greatest(c.s - 59, 1), c.s - greatest(c.s - 60, 0)), "
            "'a', substring(s.t, c.e + 1, 40))"
        )
        lowered = "named_struct('b', y.b, 'a', y.a, 'lb', lower(y.b), 'ctx', concat(lower(y.b), lower(y.a)))"
        return let("y", context, let("x", lowered, f"IF({negative}, -100, {points})"))

    def scored_sql(self) -> str | None:
        """Keep bare numbers only where no labelled number lies and the score is high enough."""
        if "EMP_ID_SCORED" not in self.at:
            return None
        scored, labelled = self.at["EMP_ID_SCORED"], self._ordinals("DET10")
        taken = f"exists(g, r -> (r.s <= c.s AND c.s < r.e) OR (r.s < c.e AND c.e <= r.e))"
        after = f"substring(s.t, c.e + 1, 2) RLIKE {regex(r'^-[^\W\d_]')}"
        needed = "CASE length(c.v) WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END"
        test = f"c.o != {scored} OR (NOT {taken} AND NOT ({after}) AND {self.score_sql()} >= {needed})"
        body = let("g", f"filter(s.m, c -> {self._between(labelled)})", f"filter(s.m, c -> {test})")
        return f"IF(exists(s.m, x -> x.o = {scored}), {body}, s.m)"

    def phones_sql(self) -> str | None:
        phones = self._ordinals("DET9")
        if not phones:
            return None
        mine = self._between(phones)
        several = f"size(array_distinct(transform(filter(s.m, c -> {mine}), c -> c.o))) > 1"
        fold = S.first_wins(f"filter(s.m, c -> {mine})")
        return f"IF({several}, concat(filter(s.m, c -> NOT ({mine})), {fold}), s.m)"

    def contextual_sql(self) -> str | None:
        """Trim stop words from both ends of a contextual name; drop what is left empty."""
        mine = self._ordinals("NAM3")
        if not mine:
            return None
        stop = words(self.names.context_stop)
        bounds = (
            "named_struct('w', y, 'a', "
            f"size(y) - size(aggregate(y, array(''), (k, w) -> IF(size(k) = 1 AND lower(w) IN ({stop}), k, array_append(k, w)))) + 1, "
            f"'z', size(aggregate(reverse(y), array(''), (k, w) -> IF(size(k) = 1 AND lower(w) IN ({stop}), k, array_append(k, w)))) - 1)"
        )
        name = "IF(x.z - x.a > 0, array_join(slice(x.w, x.a + 1, x.z - x.a), ' '), '')"
        start = let(
            "i",
            "instr(concat(c.lead, c.v), d)",
            "IF(i > 0, named_struct('s', c.s - length(c.lead) + i - 1, 'z', length(d)), "
            "named_struct('s', c.s, 'z', length(c.v)))",
        )
        span = let(
            "q",
            start,
            "named_struct('s', q.s, 'n', -q.z, 'o', c.o, 'e', q.s + q.z, 'lead', c.lead, 'v', IF(q.z = length(d), d, c.v))",
        )
        trimmed = let(
            "y",
            f"split({strip_sql('c.v')}, '\\\\s+')",
            let("x", bounds, let("d", name, f"IF(length(d) < 2 OR ({self._shouting('d')}), NULL, {span})")),
        )
        moved = f"filter(transform(filter(s.m, c -> {self._between(mine)}), c -> {trimmed}), c -> c IS NOT NULL)"
        return (
            f"IF(exists(s.m, c -> {self._between(mine)}), concat(filter(s.m, c -> NOT ({self._between(mine)})), {moved}), s.m)"
        )

    def near_email_sql(self) -> str | None:
        """Names spelled in an address and written out in the 100 characters before it."""
        if "NAME_NEAR_EMAIL" not in self.at or not self.config.enable_regex:
            return None
        o = self.at["NAME_NEAR_EMAIL"]
        email = next(d for _, d in catalog.all_detectors() if d.name == "EMAIL")
        parts = "filter(split(lower(substring_index(c.v, '@', 1)), '[._-]'), p -> length(p) >= 2 AND NOT (p RLIKE '^[0-9]+$'))"
        window = "substring(s.t, greatest(c.s - 99, 1), c.s - greatest(c.s - 100, 0))"
        # the pattern is a value of the row, so its matches are found with locate and tested for word edges
        seek = (
            "filter(sequence(1, length(x.w) - length(n) + 1), i -> substring(lower(x.w), i, length(n)) = n "
            f"AND NOT (substring(x.w, i - 1, IF(i > 1, 1, 0)) RLIKE {regex(r'\w')}) "
            f"AND NOT (substring(x.w, i + length(n), 1) RLIKE {regex(r'\w')}))"
        )
        found = (
            f"flatten(transform(array(concat(x.p[0], ' ', x.p[1]), concat(x.p[1], ' ', x.p[0])), n -> "
            f"IF(length(x.w) < length(n) OR NOT contains(lower(x.w), n), {S.NONE}, transform({seek}, i -> "
            f"named_struct('s', greatest(c.s - 100, 0) + i - 1, 'n', -length(n), 'o', {o}, "
            "'e', greatest(c.s - 100, 0) + i - 1 + length(n), 'lead', '', 'v', substring(x.w, i, length(n)))))))"
        )
        spelled = let("x", f"named_struct('p', p, 'w', {window})", found)
        each = let("p", parts, f"IF(size(p) < 2, {S.NONE}, {spelled})")
        names = f"flatten(transform({S.find('s.t', email)}, c -> {each}))"
        return f"IF(contains(s.t, '@'), concat(s.m, {names}), s.m)"

    def dictionary_sql(self) -> str | None:
        """Capitalised phrases that hold a known name."""
        if "CAPITALISED_NAME" not in self.at:
            return None
        known = words(self.names.known)
        title, upper, single = (self.at[n] for n in ("CAPITALISED_NAME", "UPPER_NAME", "SINGLE_NAME"))
        lead = f"size(aggregate(y, array(''), (k, w) -> IF(size(k) = 1 AND lower(w) IN ({words(W.LEAD_IN_WORDS)}), k, array_append(k, w)))) - 1"
        good = (
            f"size(x) >= 2 AND lower(x[size(x) - 1]) NOT IN ({words(W.PLACE_WORDS)}) "
            f"AND exists(x, w -> lower(w) IN ({known}))"
        )
        skip = "aggregate(slice(y, 1, size(y) - size(x)), 0, (k, w) -> k + length(w) + 1)"
        span = let(
            "q",
            skip,
            "named_struct('s', c.s + q, 'n', c.s + q - c.e, 'o', c.o, 'e', c.e, 'lead', c.lead, 'v', substring(c.v, q + 1, length(c.v)))",
        )
        capital = let(
            "y",
            "split(c.v, '\\\\s+')",
            let("x", f"slice(y, size(y) - ({lead}) + 1, {lead})", f"IF({good}, {span}, NULL)"),
        )
        one = (
            f"CASE c.o WHEN {title} THEN {capital} "
            f"WHEN {upper} THEN IF(exists(split(lower(c.v), '\\\\s+'), w -> w IN ({known})), c, NULL) "
            f"WHEN {single} THEN IF(lower(c.v) IN ({known}) AND lower(c.v) NOT IN ({words(W.NOT_A_SINGLE_NAME)}), c, NULL) "
            "ELSE c END"
        )
        return f"filter(transform(s.m, c -> {one}), c -> c IS NOT NULL)"

    # -- the stages -----------------------------------------------------------

    @staticmethod
    def _put(name: str, value: str, *keep: str) -> str:
        kept = "".join(f"'{k}', s.{k}, " for k in keep)
        return f"named_struct({kept}'{name}', {value})"

    def text_stages(self, raw: bool = True) -> list[str]:
        """From the raw text ``s`` to ``s.x`` (if ``raw``) and ``s.t`` (cleaned). Blank texts become NULL."""
        along = ("x",) if raw else ()
        first = "'x', s, " if raw else ""
        stages = [f"IF(s IS NOT NULL AND s RLIKE {regex(r'\S')}, named_struct({first}'t', {unmark_sql('s')}), NULL)"]
        if self.config.enable_data_cleaning:
            stages += [self._put("t", step.replace("{0}", "s.t"), *along) for step in clean_steps(self.config)]
        return stages

    def find_stages(self, raw: bool = True) -> list[str]:
        """Every finding that passes its rules, before overlaps are resolved, in ``s.m``."""
        along = ("x", "t") if raw else ("t",)
        stages = [
            self._put("l", "lower(s.t)", *along),
            self._put("f", S.flags("s.t", "s.l", self.rows), *along, "l"),
            self._put("h", S.hits(self.rows, "s.t", "s.l", "s.f"), *along),
            self._put("m", self.passing_sql(S.spans("s.h", {r.detector.span for r in self.rows})), *along),
        ]
        for build in (
            self.emails_sql,
            self.directory_sql,
            self.phones_sql,
            self.scored_sql,
            self.contextual_sql,
            self.dictionary_sql,
            self.near_email_sql,
        ):
            value = build()
            if value:
                stages.append(self._put("m", value, *along))
        return stages

    def chosen_sql(self, every: bool) -> str:
        """The kept spans, each with its token and its place in ``s.z``."""
        chosen = (
            f"named_struct('i', i, 's', c.s, 'n', c.n, 'o', c.o, 'e', c.e, 'lead', c.lead, 'v', c.v, 'tok', {self.token_sql()})"
        )
        return f"transform(s.z, (c, i) -> {chosen})" if every else f"transform(s.i, i -> {let('c', 's.z[i]', chosen)})"

    def latest_sql(self, kept: str) -> str:
        """Where the same place gets the same token twice, the later layer is reported."""
        same = f"w.s = z.s AND w.n = z.n AND {self.token_sql().replace('c.', 'w.')} = z.tok"
        latest = f"array_max(transform(filter(slice(s.z, z.i + 1, {len(self.rows) + 1}), w -> {same}), w -> w.o))"
        return (
            f"transform({kept}, z -> named_struct('i', z.i, 's', z.s, 'n', z.n, "
            f"'o', {latest}, 'e', z.e, 'lead', z.lead, 'v', z.v, 'tok', z.tok))"
        )

    def keep_stages(self, *kept: str) -> list[str]:
        """Disjoint findings in order, each with its token, in ``s.k``. ``kept``: what else goes along."""
        return [
            self._put("z", "sort_array(s.m)", *kept),
            self._put("i", S.resolve("s.z"), *kept, "z"),
            self._put("k", f"IF(size(s.i) = size(s.z), {self.chosen_sql(True)}, {self.chosen_sql(False)})", *kept, "z"),
            self._put("k", f"IF(size(s.k) = size(s.z), s.k, {self.latest_sql('s.k')})", *kept),
        ]

    def rewrite_stages(self) -> list[str]:
        """The redacted text in ``s.r``, and whether a signature was cut in ``s.cut``."""
        return [
            self._put("r", S.splice("s.t", "s.k", "c.tok"), "x", "t", "k"),
            self._put("r", self.cleanup_sql(), "x", "t", "k"),
            f"named_struct('x', s.x, 't', s.t, 'k', s.k, 'r', s.r, 'cut', {self.signature_sql()})",
            f"named_struct('x', s.x, 't', s.t, 'k', s.k, 'r', {self.finish_sql()}, 'cut', s.cut)",
        ]

    def cleanup_sql(self) -> str:
        """Second look at a text that holds tokens: leftovers right behind a token."""
        known = words(self.names.known)
        adjacent = next(i for i, d in enumerate(catalog.CLEANUP) if d.name == "ADJACENT_NAME")
        found = f"filter({S.find('s.r', *catalog.CLEANUP)}, c -> c.o != {adjacent} OR lower(c.v) IN ({known}))"
        tokens = f"element_at({array([token(self.config, d.kind) for d in catalog.CLEANUP])}, c.o + 1)"
        kept = let("z", f"array_sort({found})", f"transform({S.resolve('z')}, i -> z[i])")
        present = any_of("s.r", ("[EMP_ID]", "[NAME]", "[EMAIL]", "[PHONE]"))
        return f"IF({present}, {S.splice('s.r', kept, tokens)}, s.r)"

    def signature_sql(self) -> str:
        """Whether a closing formula is there, from which on everything becomes one token."""
        cfg = self.config
        if not cfg.enable_context_rules or (cfg.only and "SPN9" not in cfg.only):
            return "FALSE"
        marker = regex(catalog.SIGNATURE_START, icase=True)
        return f"s.r RLIKE {marker}"

    def finish_sql(self) -> str:
        marker = regex(catalog.SIGNATURE_START, icase=True)
        cut = f"IF(s.cut, concat(split(s.r, {marker}, 2)[0], {lit(' ' + token(self.config, 'SIGNATURE'))}), s.r)"
        squeeze = f"IF(q RLIKE {regex(r'\s{2}')}, regexp_replace(q, {regex(r'\s{2,}')}, ' '), q)"
        return let("q", cut, let("p", squeeze, strip_sql("p")))

    def _static_fields(self) -> str:
        confidence = "array(" + ", ".join(f"{r.family.confidence}D" for r in self.rows) + ")" if self.rows else "array(0.0D)"
        method = self._static([r.family.method for r in self.rows] or [""])
        return f"'confidence', element_at({confidence}, c.o + 1), 'method', {method}"

    def finding_sql(self, tok: str = "c.tok") -> str:
        """One finding from a kept span ``c``. ``original`` is cut from the cleaned text."""
        return (
            f"named_struct('original', {ORIGINAL}, 'replacement', {tok}, "
            f"'pi_type', {self.type_sql()}, 'start', c.s, 'end', c.e, {self._static_fields()})"
        )

    def findings_sql(self) -> str:
        """The findings of the kept places; where all are kept, straight from the spans."""
        some = f"transform({self.latest_sql(self.chosen_sql(False))}, c -> {self.finding_sql()})"
        every = f"transform({self.chosen_sql(True)}, c -> {self.finding_sql()})"
        if not self._mixed():
            every = f"transform(s.z, c -> {self.finding_sql(self.token_sql())})"
        return f"IF(size(s.i) = size(s.z), {every}, {some})"

    # -- what callers ask for: raw text in, wanted value out --------------------

    def cleaned(self) -> list[str]:
        return [*self.text_stages(), "s.t"]

    def redacted(self) -> list[str]:
        # the raw text travels along, so that blank texts can come back as they were
        return [*self.text_stages(), *self.find_stages(), *self.keep_stages("x", "t"), *self.rewrite_stages(), "s.r"]

    def rewritten(self) -> list[str]:
        """The redacted text where something was found, else NULL: callers keep what they have byte for byte."""
        splice, cleanup, cut, _ = self.rewrite_stages()
        return [
            *self.text_stages(), *self.find_stages(), *self.keep_stages("x", "t"), splice, cleanup, cut,
            f"IF(NOT s.cut AND s.r = s.t, NULL, {self.finish_sql()})",
        ]

    def found(self) -> list[str]:
        # the raw text is not asked for, and behind the rules neither is the cleaned one
        ordered, resolved, *_ = self.keep_stages()
        return [*self.text_stages(False), *self.find_stages(False), ordered, resolved, self.findings_sql()]

    def detailed(self) -> list[str]:
        signature = (
            f"named_struct('original', '[signature block]', 'replacement', {lit(token(self.config, 'SIGNATURE'))}, "
            "'pi_type', 'SIGNATURE', 'start', -1, 'end', -1, 'confidence', 0.95D, 'method', 'context')"
        )
        return [
            *self.text_stages(), *self.find_stages(), *self.keep_stages("x", "t"), *self.rewrite_stages(),
            f"named_struct('x', s.x, 'r', s.r, 'cut', s.cut, 'd', transform(s.k, c -> {self.finding_sql()}))",
            f"named_struct('redacted_text', s.r, 'redactions', IF(s.cut, array_append(s.d, {signature}), s.d), "
            "'original_length', length(s.x), 'redacted_count', size(s.d) + IF(s.cut, 1, 0))",
        ]

    def candidates(self) -> list[str]:
        """Findings before overlap resolution, for jobs that add more from other tables."""
        item = (
            f"named_struct('start', c.s, 'end', c.e, 'ord', c.o, 'original', substring(s.t, c.s + 1, c.e - c.s), "
            f"'replacement', c.tok, 'pi_type', {self.type_sql()}, {self._static_fields()})"
        )
        spans = (
            "transform(s.m, c -> named_struct('s', c.s, 'e', c.e, 'o', c.o, 'lead', c.lead, 'v', c.v, "
            f"'tok', {self.token_sql()}))"
        )
        return [
            *self.text_stages(), *self.find_stages(),
            self._put("k", spans, "t"),
            f"transform(s.k, c -> {item})",
        ]
