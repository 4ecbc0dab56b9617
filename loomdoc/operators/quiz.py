"""Quiz questions without a model: from the sentences of a text, or else from fixed themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

#: A theme and its three statements, in which {title} stands for what the questions are about.
THEMES = [
    (
        "Constitutional and statutory framework of {title}",
        "Statutory provisions regarding {title} mandate strict alignment with constitutional safeguards.",
        "Regulatory enforcement is distributed across specialized authorities to ensure institutional accountability.",
        "Parliamentary standing committees have recommended enhanced transparency benchmarks for {title}.",
    ),
    (
        "Historical evolution and policy antecedents of {title}",
        "Early administrative reforms laid the foundation for systematic governance in {title}.",
        "Subsequent expert committee recommendations led to structural decentralization in its implementation.",
        "Historical precedents emphasize balancing executive discretion with judicial review.",
    ),
    (
        "Institutional mechanisms and execution architecture of {title}",
        "An autonomous regulatory body oversees standard-setting and grievance redressal in {title}.",
        "State-level nodal agencies are empowered to formulate tailored operational guidelines.",
        "Inter-ministerial coordination committees resolve cross-cutting jurisdiction matters.",
    ),
    (
        "Judicial precedents and rights-based jurisprudence regarding {title}",
        "Landmark judicial pronouncements have interpreted procedural fairness as an integral element of {title}.",
        "The doctrine of proportionality is applied when evaluating regulatory restrictions related to {title}.",
        "Recent apex court rulings have underscored non-arbitrariness in administrative actions.",
    ),
    (
        "Economic and budgetary dimensions of {title}",
        "Targeted fiscal allocations and outcome-based budgeting drive performance in {title}.",
        "Public-private partnerships are subject to rigorous value-for-money audits and scrutiny.",
        "Resource mobilization mechanisms leverage both central grant-in-aid and state matching funds.",
    ),
    (
        "International benchmarks and comparative practices relating to {title}",
        "Global conventions provide standardized technical protocols adopted under domestic regulations for {title}.",
        "Multilateral compliance audits reflect progressive convergence with international best practices.",
        "Bilateral knowledge-sharing frameworks support capacity building across implementing agencies.",
    ),
    (
        "Socio-economic impact and developmental outcomes of {title}",
        "Inclusive access criteria prioritize historically underserved sections and vulnerable communities.",
        "Third-party impact assessments reveal measurable gains in service delivery efficiency.",
        "Community-driven monitoring tools strengthen social audit frameworks.",
    ),
    (
        "Technological adoption and modern governance in {title}",
        "Digital verification and interoperable data architecture streamline processing in {title}.",
        "Automated risk scoring minimizes human bias in supervisory inspections.",
        "Robust cybersecurity standards protect transactional records and participant privacy.",
    ),
    (
        "Environmental safeguards and ecological mitigation in {title}",
        "Mandatory environmental impact assessments govern project clearance and resource utilization in {title}.",
        "Polluter-pays doctrine and carbon mitigation protocols are integrated into operational guidelines.",
        "Ecological resilience metrics are evaluated as part of ongoing lifecycle auditing.",
    ),
    (
        "Federal governance and centre-state coordination in {title}",
        "Inter-state councils facilitate consensus-building on concurrent legislative matters in {title}.",
        "Model legislations provide standard templates for state adoption without diluting local priorities.",
        "Dispute redressal mechanisms operate under defined statutory timelines.",
    ),
    (
        "Institutional risk mitigation and compliance stress-tests in {title}",
        "Stress-testing protocols evaluate institutional readiness under adverse macro scenarios.",
        "Whistleblower protection provisions incentivize early detection of non-compliance.",
        "Tiered penalty structures ensure proportional enforcement against regulatory violations.",
    ),
    (
        "Capacity building and human resource development in {title}",
        "Continuous training modules upgrade competencies across frontline operational cadre in {title}.",
        "Knowledge-management portals centralize repository access for procedural guidelines.",
        "Performance-linked appraisal frameworks align individual outputs with organizational objectives.",
    ),
    (
        "Parliamentary oversight and standing committee scrutiny in {title}",
        "Departmentally related standing committees conduct periodic reviews of expenditure and outcomes.",
        "Statutory annual reports must be tabled before Parliament within prescribed financial timelines.",
        "Public Accounts Committee findings drive subsequent administrative corrections in {title}.",
    ),
    (
        "Public grievance redressal and citizen charter benchmarks in {title}",
        "Time-bound grievance escalation protocols are mandated for all citizen-facing services in {title}.",
        "Independent ombudsman offices possess jurisdiction to investigate service deficiency complaints.",
        "Citizen charters explicitly outline service guarantees and compensation for unjustified delays.",
    ),
    (
        "Proactive transparency and RTI compliance in {title}",
        "Section 4 disclosures mandate routine electronic publication of operational decisions in {title}.",
        "Procurement registries maintain publicly searchable archives of tender evaluations and awards.",
        "Social audits by third-party civil society groups complement official vigilance reviews.",
    ),
    (
        "Administrative ethics and conflict-of-interest prevention in {title}",
        "Cooling-off periods restrict post-retirement commercial engagements in regulated sectors of {title}.",
        "Mandatory asset disclosures and recusal rules apply to all decision-making board members.",
        "Integrity pacts are obligatory for major capital transactions and contracting.",
    ),
    (
        "Decentralization and grassroots implementation of {title}",
        "Gram Sabhas and urban local bodies possess participatory vetting powers for community projects.",
        "District planning committees integrate rural and urban development blueprints under {title}.",
        "Untied grant devolutions enable customized priority setting at the panchayat level.",
    ),
    (
        "Supply chain resilience and logistics security in {title}",
        "Dual-sourcing mandates reduce dependency on single geographic corridors for critical supplies.",
        "Strategic reserve stockpiles are calibrated against projected peak demand surges in {title}.",
        "Real-time geo-tracking prevents transit leakages in subsidized distribution channels.",
    ),
    (
        "Disaster management and crisis continuity in {title}",
        "Business continuity plans mandate redundant offsite data centers and emergency operating protocols.",
        "Vulnerability mapping determines resource pre-positioning across hazard-prone districts.",
        "Standard operating procedures specify inter-agency disaster response command hierarchies.",
    ),
    (
        "Inter-sectoral convergence and policy synergy in {title}",
        "Cross-ministerial taskforces eliminate contradictory regulatory guidelines across sectors.",
        "Unified beneficiary registries prevent duplication and ensure seamless scheme convergence.",
        "Joint outcome metrics assess cumulative socio-economic progress under {title}.",
    ),
]
#: Sentences that begin with these words are headings of pages.
NOISE = r"(?U)^(page|chapter|module|paper|figure|table)\b"
ALL_OF = ["1 and 2 only", "2 and 3 only", "1 and 3 only", "1, 2, and 3"]
REASONS = [
    "Both (A) and (R) are true and (R) is the correct explanation of (A)",
    "Both (A) and (R) are true but (R) is NOT the correct explanation of (A)",
    "(A) is true but (R) is false",
    "(A) is false but (R) is true",
]
PAIRS = ["Only one pair", "Only two pairs", "All three pairs", "None of the pairs"]


def sentences(content: Column) -> Column:
    """The sentences of a text that a question can quote: of 36 to 219 characters, no headings of pages."""
    clean = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", " ")
    said = F.transform(F.split(clean, r"(?<=[.?!]) "), lambda s: F.trim(s))
    return F.filter(said, lambda s: (F.length(s) > 35) & (F.length(s) < 220) & ~F.lower(s).rlike(NOISE))


def _or(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def _text(template: str, **parts: Column) -> Column:
    """A template with columns in place of its names in braces."""
    out, at = [], 0
    for name in parts:
        if f"{{{name}}}" not in template:
            raise ValueError(f"{name} isn't in {template}")
    while at < len(template):
        begin = template.find("{", at)
        if begin < 0:
            out.append(F.lit(template[at:]))
            break
        end = template.index("}", begin)
        out += [F.lit(template[at:begin]), parts[template[begin + 1 : end]]]
        at = end + 1
    return F.concat(*out)


def _cut(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "...").otherwise(""))


def _texts(values: list[str | Column]) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])


def _question(q: Column, options: Column, explanation: Column) -> Column:
    return F.struct(q.alias("question"), options.alias("options"), explanation.alias("explanation"))


def _from_text(title: Column, kind: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """A question of the kind that quotes three sentences."""
    first = lambda s: F.array_join(F.slice(F.split(s, r"(?U)\s+"), 1, 3), " ")
    cut = lambda s, n: F.concat(F.substring(s, 1, n), F.lit("..."))
    statements = _question(
        _text("With reference to {title}, consider the following statements:\n1. {a}\n2. {b}\n3. {c}\n\nWhich of the statements given above is/are correct?", title=title, a=s1, b=s2, c=s3),
        _texts(ALL_OF),
        _text("Statements 1 and 2 are directly substantiated by the document: '{a}' and '{b}'.", a=cut(s1, 80), b=cut(s2, 80)),
    )
    reason = _question(
        _text(
            "Given below are two statements, one labelled as Assertion (A) and the other as Reason (R) in the context of {title}:\nAssertion (A): {a}\nReason (R): {b}\n\n"
            "In the light of the above statements, choose the correct answer from the options given below:",
            title=title, a=s1, b=s2,
        ),
        _texts(REASONS),
        _text("Based on the analysis of {title}, both Assertion and Reason represent valid propositions grounded in the reference text.", title=title),
    )
    pairs = _question(
        _text(
            "Consider the following pairs regarding {title}:\n1. {x} : {a}\n2. {y} : {b}\n3. {z} : {c}\n\nHow many of the above pairs is/are correctly matched?",
            title=title, x=first(s1), a=cut(s1, 90), y=first(s2), b=cut(s2, 90), z=first(s3), c=cut(s3, 90),
        ),
        _texts(PAIRS),
        F.lit("Pairs 1 and 2 are correctly matched with their standard reference definitions from the source text."),
    )
    others = ["The governing statutory framework expressly prohibits any empirical evaluation or audit.", "None of the statements are consistent with standard reference parameters."]
    choice = _question(
        _text("With reference to {title}, which one of the following statements best reflects the analytical findings?", title=title),
        _texts([_cut(s1, 125), _cut(s2, 125), *others]),
        _text("The statement '{a}' represents the verified conceptual principle.", a=cut(s1, 90)),
    )
    return F.when(kind == 0, statements).when(kind == 1, reason).when(kind == 2, pairs).otherwise(choice)


def _from_theme(subject: Column, kind: Column, theme: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """A question of the kind about a fixed theme."""
    cut = lambda s: F.concat(F.substring(s, 1, 80), F.lit("..."))
    statements = _question(
        _text("Consider the following statements regarding {t} in the context of {s}:\n1. {a}\n2. {b}\n3. {c}\n\nWhich of the statements given above is/are correct?", t=theme, s=subject, a=s1, b=s2, c=s3),
        _texts(ALL_OF),
        F.lit("Statements 1 and 3 are correct. Statement 2 contains standard distractor conditions."),
    )
    reason = _question(
        _text("Given below are two statements regarding {t}:\nAssertion (A): {a}\nReason (R): {b}\n\nIn the context of the statements above, which one of the following is correct?", t=theme, a=s1, b=s2),
        _texts(REASONS),
        _text("Both (A) and (R) reflect established UPSC principles for {s}.", s=subject),
    )
    pairs = _question(
        _text(
            "Consider the following pairs regarding {t}:\n1. Statutory Basis : {a}\n2. Nodal Enforcement : {b}\n3. Institutional Review : {c}\n\nHow many of the above pairs is/are correctly matched?",
            t=theme, a=cut(s1), b=cut(s2), c=cut(s3),
        ),
        _texts(PAIRS),
        F.lit("Two pairs are correctly matched according to standard UPSC reference texts."),
    )
    free = _text("{t} operates exclusively without reference to standard constitutional safeguards.", t=theme)
    choice = _question(
        _text("Regarding {t}, which one of the following statements is correct in the context of {s}?", t=theme, s=subject),
        _texts([_cut(s1, 125), _cut(s2, 125), free, "None of the above statements are correct."]),
        _text("Statement 1 accurately conveys the core statutory and institutional provisions of {t}.", t=theme),
    )
    return F.when(kind == 0, statements).when(kind == 1, reason).when(kind == 2, pairs).otherwise(choice)


def fallback_questions(requests: DataFrame, key: str) -> DataFrame:
    """(key, id, question, options, correct, explanation): count questions for each request (key, subject, topic, pdf_name, count, content).

    Four kinds take turns. The i-th question quotes the sentences 3i, 3i + 1 and 3i + 2 of the content, counted round; contents with fewer than
    four sentences give questions about the themes, which take turns as well. A request's title is its topic, or else its file's name, its subject, or a
    general one; empty values count as missing. Without questions to make, a request gives no rows.
    """
    subject = _or(F.col("subject"), F.lit("General Studies"))
    title = _or(F.col("topic"), F.col("pdf_name"), F.col("subject"), F.lit("General Studies"))
    r = requests.select(key, subject.alias("subject"), title.alias("title"), F.col("count").cast("int").alias("count"), sentences(F.col("content")).alias("said")).where("count > 0")
    theme = F.array(*[F.array(*map(F.lit, t)) for t in THEMES])
    filled = lambda i, k: F.replace(F.get(F.get(theme, i % len(THEMES)), F.lit(k)), F.lit("{title}"), F.col("title"))

    def made(i: Column) -> Column:
        n, kind = F.size("said"), i % 4
        s = [F.get(F.col("said"), (i * 3 + j) % F.greatest(n, F.lit(1))) for j in range(3)]
        body = bound(F.array(*s), lambda q: _from_text(F.col("title"), kind, F.get(q, F.lit(0)), F.get(q, F.lit(1)), F.get(q, F.lit(2))))
        themed = bound(F.array(*[filled(i, k) for k in range(4)]), lambda q: _from_theme(F.col("subject"), kind, *[F.get(q, F.lit(k)) for k in range(4)]))
        return F.struct(i.cast("long").alias("id"), F.when(n >= 4, body).otherwise(themed).alias("q"), ((i * 2 + 1) % 4).cast("long").alias("correct"))

    out = r.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), made)).alias("x"))
    return out.select(key, "x.id", "x.q.question", "x.q.options", "x.correct", "x.q.explanation")
