"""Industry, job family and seniority from titles and descriptions: ordered rules as ``CASE WHEN`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.patterns import ascii_borders, plain_spaces

# Rules in order; the first group with a matching pattern wins. Patterns ignore case except those after ``(?-i)``.
INDUSTRY_RULES = [
    ("healthcare", [
        r"\b(rn|lpn|cna|bsn|msn|dnp|np|pa-?c|dds|dvm|psyd)\b", r"(?-i)\b(M\.D\.|D\.O\.|D\.D\.S\.|D\.V\.M\.|D\.P\.T\.)", r"(?-i),\s+(MD|DO|DPT)\b",
        r"(?-i)\bDr\.\s+[A-Z][a-z]+,?\s+(MD|DO|DPT)\b", r"\b(nurse|nursing|midwife|midwifery)\b", r"\b(physician|surgeon|surgical|anesthesiolog)",
        r"\b(doctor|phd\s+psychology)\b", r"\b(hospital|clinic|patient|medical\s+(center|office|practice))\b",
        r"\b(pharmacy|pharmacist|pharmacolog|pharmaceutical\s+technician)\b", r"\b(dental|dentist|hygienist|orthodontist)\b",
        r"\b(therapist|therapy|rehabilitation|physical\s+therap)", r"\b(radiology|radiologist|sonographer|mammograph)",
        r"\b(paramedic|emt|emergency\s+medical|ambulance)\b", r"\b(phlebotom|sonogr|cardiology|oncology|pediatric|geriatric)",
        r"\b(medical\s+assistant|medical\s+coder|health\s+information)", r"\b(respiratory\s+therap|occupational\s+therap)",
        r"\b(behavioral\s+health|mental\s+health\s+counselor|clinical\s+social\s+worker)",
    ]),
    ("government", [
        r"\b(gs[-\s]?\d{1,2}|wage\s+grade|wg-\d+)\b", r"\b(federal\s+(government|employee|agency)|civil\s+service)\b",
        r"\b(department\s+of\s+\w+|bureau\s+of\s+\w+|ministry\s+of)", r"\b(sheriff|deputy\s+sheriff|police\s+officer|patrolman|trooper)\b",
        r"\b(corrections\s+officer|correctional\s+(officer|sergeant))", r"\b(army|navy|marines?|air\s+force|coast\s+guard|space\s+force)\b",
        r"\b(usajobs|federal\s+contractor|public\s+sector|municipal)", r"\b(city\s+of\s+\w+|county\s+of\s+\w+)",
    ]),
    ("education", [
        r"\b(teacher|teaching\s+(assistant|fellow|position)|educator)\b", r"\b(professor|lecturer|adjunct\s+faculty|tenure[\s-]?track)\b",
        r"\b(elementary|secondary|kindergarten|preschool|grade\s+school)\b", r"\b(school\s+(district|board|principal|nurse|counselor))\b",
        r"\b(curriculum\s+(developer|specialist)|pedagog)", r"\b(superintendent|dean\s+of\s+\w+|provost|registrar)\b",
        r"\b(special\s+(education|ed)|esl\s+teacher|substitute\s+teacher)\b", r"\bk-12|early\s+childhood\s+education",
    ]),
    ("logistics", [
        r"\b(truck\s+driver|cdl[\s-]?(driver|[ab])|delivery\s+driver|courier|chauffeur)\b",
        r"\b(warehouse\s+(associate|worker|lead|supervisor)|fulfillment\s+(associate|center))",
        r"\b(logistics|supply\s+chain|inventory\s+(specialist|manager|control))", r"\b(shipping|receiving|freight\s+(handler|broker))",
        r"\b(material\s+handler|order\s+picker|forklift\s+operator)\b",
    ]),
    ("trades", [
        r"\b(electrician|plumber|carpenter|welder|machinist|millwright)\b", r"\bhvac|heating[\s-]?and[\s-]?cooling|sheet\s+metal",
        r"\b(roofer|mason|tiler|painter|drywall|insulation)\b", r"\b(diesel\s+mechanic|auto\s+mechanic|aircraft\s+mechanic)\b",
        r"\b(apprentice|journeyman|master)\s+(electrician|plumber|carpenter|tradesman)", r"\b(pipefitter|ironworker|millwork|crane\s+operator)\b",
    ]),
    ("food_service", [
        r"\b(line\s+cook|sous\s+chef|executive\s+chef|head\s+chef|pastry\s+chef)\b", r"\b(cook|chef|baker|kitchen\s+(staff|hand|porter))\b",
        r"\b(waiter|waitress|server|host\b|hostess|bartender|barista)", r"\b(dishwasher|busser|food\s+(runner|prep))\b",
        r"\b(restaurant|cafe|bistro|diner|food\s+truck|catering)", r"\bculinary\s+(arts|professional|graduate)",
    ]),
    ("retail", [
        r"\b(cashier|stocker|sales\s+associate|store\s+associate|store\s+lead)\b", r"\b(visual\s+merchandiser|merchandiser|loss\s+prevention)\b",
        r"\b(retail\s+(manager|supervisor|associate|specialist))", r"\bstore\s+(manager|director)\b", r"\bbrand\s+(ambassador|specialist)",
        r"\b(department\s+(store|supervisor)|big\s+box)",
    ]),
    ("manufacturing", [
        r"\b(assembler|production\s+(worker|operator|associate|lead))\b", r"\b(manufactur(ing|er)|production\s+line|assembly\s+line)",
        r"\b(quality\s+(control|assurance|inspector|technician))\b", r"\b(plant\s+(manager|operator|supervisor)|machine\s+operator)\b",
        r"\b(injection\s+mold|press\s+operator|cnc\s+(machinist|operator))",
    ]),
    ("tech", [
        r"\b(software|web|mobile|backend|frontend|full[-\s]?stack)\s+(engineer|developer|architect)",
        r"\b(software|application|systems?|platform|infrastructure)\s+engineer", r"\b(programmer|developer|coder)\b",
        r"\b(devops|sre|site\s+reliability|sysadmin|cloud\s+engineer)",
        r"\b(data\s+(scientist|engineer|analyst)|machine\s+learning\s+engineer|ml\s+engineer)",
        r"\b(security\s+engineer|cybersecurity|infosec|penetration\s+tester)",
        r"\b(product\s+(manager|owner|designer)|ux\s+(designer|researcher)|ui\s+designer)\b",
        r"\b(technical\s+(writer|program\s+manager)|qa\s+(engineer|analyst))\b", r"\b(react|python|kubernetes|terraform|typescript|golang|rust)\b",
    ]),
    ("finance", [
        r"\b(accountant|cpa|bookkeeper|controller|auditor|audit\s+(manager|senior))\b", r"\b(financial\s+(analyst|advisor|planner|consultant))\b",
        r"\b(investment\s+(banker|analyst|associate)|wealth\s+(manager|advisor))", r"\b(actuar|underwrit|risk\s+(analyst|manager))",
        r"\b(trader|trading\s+(analyst|associate)|portfolio\s+manager)\b", r"\b(loan\s+(officer|processor)|mortgage\s+(broker|underwriter))",
        r"\b(tax\s+(preparer|consultant|manager|associate))",
    ]),
    ("legal", [
        r"\b(attorney|lawyer|counsel(or)?|paralegal|legal\s+(assistant|secretary))\b", r"\b(law\s+(firm|clerk|office)|litigation\s+(associate|attorney))",
        r"\b(compliance\s+(attorney|officer)|general\s+counsel)", r"\b(public\s+defender|district\s+attorney|prosecutor)",
    ]),
    ("science", [
        r"\b(scientist|researcher|research\s+(associate|scientist|fellow))\b", r"\b(biologist|chemist|physicist|geologist|astronomer)\b",
        r"\b(laborator(y|ies)|biotech\s+(researcher|engineer)|pharmaceutical\s+research)", r"\b(postdoc|postdoctoral|principal\s+investigator)\b",
        r"\b(clinical\s+(research|trial)\s+(coordinator|associate|manager))",
    ]),
    ("media", [
        r"\b(journalist|reporter|editor|copy\s+editor|managing\s+editor|writer)\b", r"\b(news\s+(anchor|producer)|broadcast\s+(journalist|engineer))",
        r"\b(photographer|videographer|content\s+creator|content\s+strategist)\b", r"\b(social\s+media\s+(manager|specialist|coordinator))\b",
    ]),
    ("nonprofit", [
        r"\b(non[\s-]?profit|501\(c\)\(3\)|ngo|charity)\b", r"\b(fundraising|grant\s+(writer|manager)|development\s+(officer|director))",
        r"\b(volunteer\s+(coordinator|manager)|community\s+organizer)\b", r"\b(foundation\s+(officer|grants)|philanthropy)",
    ]),
]
FAMILY_RULES = [
    ("registered_nurse", [r"\b(rn|registered\s+nurse)\b"]),
    ("licensed_practical_nurse", [r"\b(lpn|licensed\s+practical\s+nurse|lvn)\b"]),
    ("certified_nursing_assistant", [r"\b(cna|certified\s+nursing\s+assistant|nursing\s+assistant)\b"]),
    ("nurse_practitioner", [r"\bnurse\s+practitioner|\bnp\b"]),
    ("physician", [r"\b(physician|attending|hospitalist|medical\s+doctor)\b"]),
    ("pharmacist", [r"\bpharmacist\b"]),
    ("pharmacy_technician", [r"\bpharmacy\s+tech(nician)?\b"]),
    ("medical_assistant", [r"\bmedical\s+assistant\b"]),
    ("software_engineering", [r"\b(software|web|mobile|backend|frontend|full[-\s]?stack)\s+(engineer|developer|architect)", r"\b(software|systems|platform)\s+engineer"]),
    ("data_science", [r"\bdata\s+scientist|machine\s+learning\s+(engineer|scientist)|ml\s+engineer"]),
    ("data_engineering", [r"\bdata\s+engineer\b"]),
    ("devops", [r"\b(devops|sre|site\s+reliability)"]),
    ("product_management", [r"\bproduct\s+(manager|owner)\b"]),
    ("design", [r"\b(ux\s+(designer|researcher)|product\s+designer|visual\s+designer)\b"]),
    ("cashier", [r"\bcashier\b"]),
    ("sales_associate", [r"\b(sales|store|retail)\s+associate\b"]),
    ("store_manager", [r"\bstore\s+(manager|director|lead)\b"]),
    ("line_cook", [r"\bline\s+cook\b"]),
    ("chef", [r"\b(sous|executive|head|pastry)\s+chef|^chef\b"]),
    ("server", [r"\b(server|waiter|waitress)\b"]),
    ("bartender", [r"\bbartender|mixologist\b"]),
    ("electrician", [r"\belectrician\b"]),
    ("plumber", [r"\bplumber\b"]),
    ("carpenter", [r"\bcarpenter\b"]),
    ("hvac_technician", [r"\bhvac"]),
    ("truck_driver", [r"\b(truck\s+driver|cdl\s+driver)\b"]),
    ("delivery_driver", [r"\b(delivery\s+driver|courier|chauffeur)\b"]),
    ("warehouse_associate", [r"\bwarehouse\s+(associate|worker|lead)\b"]),
    ("teacher", [r"\b(teacher|teaching\s+position)\b"]),
    ("professor", [r"\b(professor|lecturer|adjunct\s+faculty)\b"]),
    ("police_officer", [r"\b(police\s+officer|patrolman|deputy\s+sheriff)\b"]),
    ("accountant", [r"\b(accountant|cpa|bookkeeper)\b"]),
    ("financial_analyst", [r"\bfinancial\s+analyst\b"]),
]
COMMON_LEVELS = [
    ("executive", [r"\bchief\b", r"\bvp\b", r"\bv\.p\.\b", r"\bsvp\b", r"\bevp\b", r"\bvice\s+president\b", r"\bhead\s+of\b", r"\bpresident\b", r"\b(cto|ceo|cfo|coo|cio|ciso|cpo|cno|cmo)\b"]),
    ("director", [r"\bdirector\b", r"\bsuperintendent\b"]),
    ("manager", [r"\bmanager\b", r"\bmgr\b", r"\bpeople\s+lead\b", r"\bsupervisor\b"]),
    ("intern", [r"\bintern(s|ship)?\b", r"\bsummer\s+\d{4}\b", r"\bco-?op\b"]),
]
TECH_LEVELS = [
    ("principal", [r"\bprincipal\b", r"\bdistinguished\b", r"\bfellow\b"]),
    ("staff", [r"\bstaff\b", r"\bengineer\s+(?:iv|v)\b", r"\b(?:developer|scientist|architect)\s+(?:iv|v)\b"]),
    ("senior", [r"\bsenior\b", r"\bsnr\b", r"\bsr\.?\b", r"\blead\b", r"\btech(?:nical)?\s+lead\b", r"\bengineer\s+iii\b", r"\b(?:developer|scientist|architect)\s+iii\b", r"\bfounding\b"]),
    ("junior", [
        r"\bjunior\b", r"\bjr\.?\b", r"\bassociate\b", r"\bentry[\s-]?level\b", r"\bnew[\s-]?grad", r"\bnewgrad\b",
        r"\bgraduate\s+(?:engineer|developer|analyst|scientist|programmer|trainee|software|hire|role|program|rotation)", r"\b(?:university|college)\s+graduate",
        r"\b(?:university|college)\s+hire", r"\bearly[\s-]?career\b", r"\bapprentice", r"\btrainee\b", r"\bengineer\s+i\b",
        r"\b(?:developer|scientist|architect|analyst)\s+i\b", r"\bengineer\s+1\b",
    ]),
]
RETAIL_LEVELS = [
    ("senior", [r"\bshift\s+(lead|supervisor)\b", r"\b(senior|sr)\s+(associate|cashier|barista|server|cook)\b", r"\blead\s+(associate|cashier|barista|server|line\s+cook)\b", r"\bassistant\s+store\s+manager\b", r"\bkey[\s-]?holder\b"]),
    ("junior", [r"\b(cashier|stocker|sales\s+associate|store\s+associate|sales\s+clerk)\b", r"\b(barista|server|line\s+cook|host(ess)?|busser|dishwasher)\b", r"\bcrew\s+member\b"]),
]
INDUSTRY_LEVELS = {
    "tech": TECH_LEVELS,
    "healthcare": [
        ("principal", [r"\bchief\s+(nursing|medical)\s+officer\b", r"\bmedical\s+director\b", r"\battending\s+physician\b"]),
        ("staff", [r"\bcharge\s+nurse\b", r"\bnurse\s+(manager|lead)\b", r"\b(senior|sr)\s+(physician|hospitalist)\b", r"\blead\s+(rn|nurse|tech|technician|pharmacist)\b"]),
        ("senior", [r"\b(senior|sr)\s+(nurse|rn|lpn|therapist|pharmacist|technician|technologist)\b", r"\b(senior|sr)\.?\s+"]),
        ("junior", [r"\bnew[\s-]?grad\s+(rn|nurse|nurse\s+practitioner|np)\b", r"\bgraduate\s+nurse\b", r"\bjunior\s+(rn|nurse|therapist|pharmacist|technician)\b", r"\bnursing\s+student\b", r"\b(cna|certified\s+nursing\s+assistant)\b"]),
        ("intern", [r"\b(medical\s+)?resident(\s+physician)?\b", r"\bmedical\s+student\b", r"\bfellow\s+physician\b"]),
    ],
    "retail": RETAIL_LEVELS,
    "food_service": RETAIL_LEVELS,
    "trades": [
        ("principal", [r"\bmaster\s+(electrician|plumber|carpenter|welder|tradesman|mechanic)\b"]),
        ("senior", [r"\bjourneyman\b", r"\b(senior|sr)\s+(electrician|plumber|carpenter|welder|mechanic|technician)\b"]),
        ("junior", [r"\bapprentice\b", r"\btrainee\b", r"\bhelper\b"]),
    ],
    "government": [
        ("principal", [r"\bgs[-\s]?15\b", r"\bses\s+executive\b"]),
        ("senior", [r"\bgs[-\s]?1[34]\b", r"\b(senior|sr)\s+(analyst|specialist|investigator|officer)\b", r"\blieutenant\b", r"\bsergeant\b"]),
        ("mid", [r"\bgs[-\s]?(9|1[012])\b"]),
        ("junior", [r"\bgs[-\s]?[3-7]\b", r"\b(trainee|recruit|cadet|deputy\s+i)\b"]),
    ],
    "education": [
        ("principal", [r"\bfull\s+professor\b", r"\bdistinguished\s+(professor|fellow)\b", r"\bdean\b", r"\bendowed\s+(chair|professor)\b"]),
        ("senior", [r"\bassociate\s+professor\b", r"\bdepartment\s+(head|chair)\b", r"\blead\s+(teacher|instructor)\b"]),
        ("junior", [r"\bassistant\s+professor\b", r"\b(new|first[\s-]?year)\s+teacher\b", r"\bsubstitute\s+teacher\b", r"\bteaching\s+(assistant|fellow)\b"]),
    ],
}
LADDER = ["intern", "junior", "mid", "senior", "staff", "principal"]
SECTION_ANCHORS = [
    r"\bminimum\s+(?:qualifications?|requirements?)\b", r"\bbasic\s+(?:qualifications?|requirements?)\b", r"\bpreferred\s+(?:qualifications?|requirements?)\b",
    r"\brequired\s+(?:experience|qualifications?|requirements?)\b", r"\b(?:must|should)\s+have\b", r"\bwhat\s+you(?:’|')?ll?\s+(?:bring|need|have)\b",
    r"\bwhat\s+you\s+(?:bring|need|have)\b", r"\bwhat\s+we(?:’|')?re\s+looking\s+for\b", r"\babout\s+you\b", r"\byour\s+experience\b",
    r"\bqualifications?\s*[:—–\-\n]", r"\brequirements?\s*[:—–\-\n]", r"\bexperience\s*[:—–\-\n]",
]
SECTION_RANGE = r"\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s+years?\b[^.]{0,80}?\bexperience\b"
SECTION_YEARS = [
    r"\b(\d{1,2})\s*\+?\s*years?\b[^.]{0,80}?\bexperience\b", r"\bexperience\b[^.]{0,40}?\b(\d{1,2})\s*\+?\s*years?\b",
    r"\b(?:minimum|at\s+least|over)\s+(?:of\s+)?(\d{1,2})\s*\+?\s*years?\b", r"\b(\d{1,2})\s*\+?\s*years?\s+(?:minimum|or\s+more|or\s+greater)\b",
]
YEARS_OF = (
    r"(?:professional|relevant|industry|software|engineering|product|work|paid|hands-on|dev|development|technical|coding|leadership|nursing|teaching|"
    r"legal|design|sales|marketing|operations|customer|clinical|business|enterprise|outbound)(?:\s+[a-z-]+){0,3}\s+experience\b"
)
BODY_RULES = [
    ("junior", [
        r"\bnew[\s-]?grad(uate)?s?\b", r"\brecent\s+grad(uate)?s?\b", r"\bentry[\s-]?level\b", r"\bearly[\s-]?career\b", r"\bearly\s+in\s+(?:your|their)\s+career\b",
        r"\bjust\s+(?:starting|started)\s+(?:your|their)\s+career\b", r"\bgraduating\s+(?:in|by|with)\b", r"\bclass\s+of\s+20\d{2}\b",
        r"\b(?:0|1|2)\s*[-–]\s*[123]\s*years?\s+(?:of\s+)?" + YEARS_OF, r"\b(?:0|1|2)\+?\s*years?\s+(?:of\s+)?" + YEARS_OF,
        r"\bminimum\s+(?:of\s+)?(?:0|1|2)\+?\s*years?\b", r"\bno\s+(?:prior\s+|professional\s+|previous\s+|formal\s+)?experience\s+(?:required|necessary|needed|expected)\b",
        r"\bfirst[\s-]?year\s+(?:role|developer|engineer|hire|analyst|nurse|teacher)\b",
    ]),
    ("senior", [
        r"\b(?:7|8|9|10|12|15|20)\s*\+?\s*years?\s+(?:of\s+)?" + YEARS_OF, r"\b(?:7|8|9|10|12|15|20)\s*\+?\s*years?\s+experience\s+(?:required|preferred|in)\b",
        r"\bminimum\s+(?:of\s+)?(?:7|8|9|10|12|15|20)\s*\+?\s*years?\b",
    ]),
    ("mid", [
        r"\b(?:3|4|5)\s*[-–]\s*[567]\s*years?\s+(?:of\s+)?" + YEARS_OF, r"\b(?:3|4|5|6)\s*\+?\s*years?\s+(?:of\s+)?" + YEARS_OF,
        r"\b(?:3|4|5|6)\s*\+?\s*years?\s+experience\s+(?:required|preferred|in)\b", r"\bminimum\s+(?:of\s+)?(?:3|4|5|6)\s*\+?\s*years?\b",
    ]),
]
SAMPLE_CHARS = 300
BODY_CHARS = 5000
WINDOW_CHARS = 600


def any_of(patterns: list[str]) -> str:
    """One pattern for a rule: alternatives keep their own case rule."""
    return "|".join(f"(?:{p.removeprefix('(?-i)')})" if p.startswith("(?-i)") else f"(?i:{p})" for p in patterns)


def first_rule(text: Column, rules: list) -> Column:
    """Label of the first rule that matches; null if none does."""
    out = None
    for label, patterns in rules:
        hit = text.rlike(ascii_borders(any_of(patterns)))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def haystack(title: Column, description: Column) -> Column:
    return F.trim(plain_spaces(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, SAMPLE_CHARS))))


def classify_industry(title: Column, description: Column) -> Column:
    return F.coalesce(first_rule(haystack(title, description), INDUSTRY_RULES), F.lit("other"))


def classify_job_family(title: Column, description: Column) -> Column:
    return first_rule(haystack(title, description), FAMILY_RULES)


def classify_title_level(title: Column, industry: Column) -> Column:
    """Rules for all, then those of the industry, then those of tech."""
    t = F.trim(plain_spaces(title))
    own = None
    for name, rules in INDUSTRY_LEVELS.items():
        if name != "tech":
            own = F.when(industry == name, first_rule(t, rules)) if own is None else own.when(industry == name, first_rule(t, rules))
    return F.coalesce(first_rule(t, COMMON_LEVELS), own, first_rule(t, TECH_LEVELS))


def years_level(years: Column) -> Column:
    return F.when(years <= 2, "junior").when(years <= 6, "mid").when(years.isNotNull(), "senior")


def body_text(description: Column) -> Column:
    plain = F.replace(F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))
    return plain_spaces(F.substring(plain, 1, BODY_CHARS))


def _at(text: Column, pattern: str) -> Column:
    """Place of the first match, from 1; null if there is none."""
    return F.nullif(F.regexp_instr(text, F.lit(f"(?i){ascii_borders(pattern)}")), F.lit(0))


def body_level_section(text: Column) -> Column:
    """struct(pos, level) of the first section whose window states years of experience."""
    at = F.array_compact(F.array(*[_at(text, p) for p in SECTION_ANCHORS]))

    def told(pos: Column) -> Column:
        window = F.substring(text, pos, F.lit(WINDOW_CHARS))
        ways = [F.struct(_at(window, p).alias("at"), F.lit(k).alias("k"), F.regexp_extract(window, f"(?i){ascii_borders(p)}", 1).try_cast("int").alias("years")) for k, p in enumerate([SECTION_RANGE, *SECTION_YEARS])]
        best = F.array_min(F.filter(F.array(*ways), lambda w: w["at"].isNotNull()))
        return F.struct(pos.alias("pos"), years_level(best["years"]).alias("level"))

    return F.array_min(F.filter(F.transform(at, told), lambda x: x["level"].isNotNull()))


def body_level_keyword(text: Column) -> Column:
    """struct(pos, level) of the first keyword match; rule order breaks ties."""
    ways = [F.struct(_at(text, p).alias("pos"), F.lit(k * 100 + i).alias("k"), F.lit(level).alias("level")) for k, (level, ps) in enumerate(BODY_RULES) for i, p in enumerate(ps)]
    best = F.array_min(F.filter(F.array(*ways), lambda w: w["pos"].isNotNull()))
    return F.struct(best["pos"].alias("pos"), best["level"].alias("level"))


def classify_body(description: Column) -> Column:
    text = body_text(description)
    section, keyword = body_level_section(text), body_level_keyword(text)
    return F.when(section["pos"] <= keyword["pos"], section["level"]).otherwise(F.coalesce(keyword["level"], section["level"]))


def classify_title_or_body(title: Column, description: Column, industry: Column) -> Column:
    by_title = classify_title_level(title, industry)
    return F.when(by_title.isin("manager", "director", "executive"), by_title).otherwise(F.coalesce(classify_body(description), by_title))


def levels_at_or_below(level: Column) -> Column:
    ladder = F.array(*[F.lit(x) for x in LADDER])
    at = F.array_position(ladder, level)
    return F.when(level.isNotNull(), F.when(at > 0, F.slice(ladder, F.lit(1), at.cast("int"))).otherwise(F.array(level)))
