"""Cleaning, normalising, parsing and prompt text as Column expressions (Catalyst sees all of it)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (T7, T18): the articles that answers lose, the reasoning tags (the first one's blocks go whole) and the roles beside chat control tokens.
ARTICLES = ("le", "la", "les", "un", "une", "des", "du", "de", "l'")
REASONING = ("think", "reasoning", "reflection", "analysis")
CHAT_ROLES = ("assistant", "user", "system")

# The system prompt and the instructions of the three tasks.
SYSTEM = (
    "Tu es un assistant médical expert francophone. RÈGLES STRICTES:\n"
    "1. Tu réponds EXCLUSIVEMENT en français. Jamais en anglais.\n"
    "2. Tu suis EXACTEMENT le format de réponse demandé.\n"
    "3. Tu n'ajoutes aucune explication, préambule, ou commentaire non demandé.\n"
    "4. Si on te demande des lettres, tu donnes uniquement des lettres.\n"
    "5. Si on te demande un passage du texte, tu copies ce passage sans le reformuler."
)
MCQA = (
    "TÂCHE: Question à choix multiples. Choisis la ou les bonnes réponses.\n"
    "FORMAT DE RÉPONSE (OBLIGATOIRE):\n"
    "- Une seule lettre majuscule (ex: B), OU plusieurs lettres séparées par des virgules sans espaces (ex: A,C,E).\n"
    "- AUCUN autre caractère, mot, phrase, ou explication.\n"
    "- AUCUN raisonnement écrit. Pense en silence.\n"
    "- Réponds uniquement par les lettres."
)
EXTQA = (
    "TÂCHE: Extraction d'un passage. Trouve dans le texte ci-dessous le passage le plus court qui répond à la question.\n"
    "FORMAT DE RÉPONSE (OBLIGATOIRE):\n"
    "- Recopie EXACTEMENT le passage du texte, sans le reformuler.\n"
    "- Le passage doit être TRÈS COURT et CIBLÉ (idéalement 1 à 10 mots).\n"
    "- AUCUN préambule, AUCUN guillemets, AUCUN explication.\n"
    "- Si le texte ne contient pas la réponse, réponds par un seul mot pertinent du texte."
)
ABSQA = (
    "TÂCHE: Question médicale ouverte. Réponds en français.\n"
    "FORMAT DE RÉPONSE:\n"
    "- Réponse claire, concise, médicalement exacte, EN FRANÇAIS UNIQUEMENT.\n"
    "- Maximum 3 à 5 phrases.\n"
    "- Pas de raisonnement étape-par-étape — donne directement la réponse."
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """fn(value) with value computed once, however often the lambda functions inside fn use it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: Column | str) -> Column:
    """Strip Unicode white space on both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def approx_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4)).cast("long")


def fixed(x: Column | str, digits: int, *, plus: bool = False) -> Column:
    """x with so many decimals, the exact binary value rounded half to even as C's printf does; "+" before what is not negative, if asked for.

    The product with the power of ten is split into its rounded value and its exact error, so a tie is told from what
    only looks like one.  From 2^52 / 10^digits on the digits are those of the shortest decimal that names the double.
    """
    value = col(x).cast("double")

    def of(d: Column) -> Column:
        size, scale = F.abs(d), float(10**digits)

        def split(p: Column) -> Column:
            # Dekker's product; 10^digits has few enough bits to need no splitting itself
            c = size * 134217729.0
            high = c - (c - size)
            error = (high * scale - p) + (size - high) * scale
            whole = F.floor(p)
            part = p - whole
            up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
            return whole + up.cast("long")

        n = bind(size * scale, split)
        text = bind(n, lambda k: F.concat(F.floor(k / 10**digits).cast("string"), F.lit("."), F.lpad((k % 10**digits).cast("string"), digits, "0")) if digits else k.cast("string"))
        sign = F.when(d.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
        large = F.format_string(f"%.{digits}f", size)
        return F.when(F.isnan(d), "+nan" if plus else "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size >= 2.0**52 / scale, F.concat(sign, large)).otherwise(F.concat(sign, text))

    return bind(value, of)


def clean_text(text: Column | str) -> Column:
    """Control characters and runs of blanks become one space, three or more line feeds two; ends are stripped; null is empty."""
    t = F.coalesce(col(text), F.lit(""))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def normalize_answer(s: Column | str) -> Column:
    """Lower case; French articles before white space, punctuation and repeated blanks go."""
    t = strip(F.lower(F.coalesce(col(s), F.lit(""))))
    t = F.regexp_replace(t, rf"(?U)\b({'|'.join(ARTICLES)})\s+", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_for_hash(text: Column | str) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def hash_text(s: Column | str) -> Column:
    return F.substring(F.sha1(F.coalesce(col(s), F.lit(""))), 1, 12)


def options_from_list(options: Column | str) -> Column:
    """['x', 'y'] -> {'A': 'x', 'B': 'y'}."""
    return F.map_from_entries(F.transform(col(options), lambda x, i: F.struct(F.char(F.lit(65) + i), x)))


def format_options(options: Column | str) -> Column:
    """A map of letters to texts as sorted 'k) v' lines."""
    entries = F.array_sort(F.map_entries(col(options)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def mcqa_prompt(question: Column | str, options: Column | str) -> Column:
    return F.concat(F.lit(f"{MCQA}\n\nQuestion: "), col(question), F.lit("\n\n"), format_options(options), F.lit("\n\nRéponse:"))


def extqa_prompt(context: Column | str, question: Column | str) -> Column:
    return F.concat(F.lit(f"{EXTQA}\n\nTexte:\n"), col(context), F.lit("\n\nQuestion: "), col(question), F.lit("\n\nRéponse (passage exact, court):"))


def absqa_prompt(question: Column | str, context: Column | str) -> Column:
    has = F.coalesce(col(context), F.lit("")) != ""
    shown = F.when(has, F.concat(F.lit("\n\nContexte:\n"), col(context))).otherwise(F.lit(""))
    return F.concat(F.lit(ABSQA), shown, F.lit("\n\nQuestion: "), col(question), F.lit("\n\nRéponse en français:"))


def build_messages(prompt: Column, demos: Column | None = None) -> Column:
    """System turn, (user, assistant) for each demo struct(prompt, answer), and the user turn."""
    head = F.array(message("system", F.lit(SYSTEM)))
    shots = [] if demos is None else [F.flatten(F.transform(demos, lambda d: F.array(message("user", d["prompt"]), message("assistant", d["answer"]))))]
    return F.concat(head, *shots, F.array(message("user", prompt)))


def task_messages(task: Column | str, question: Column | str, context: Column | str, options: Column | str, answer: Column | str) -> Column:
    """A QA row as a training chat: its task's prompt and the answer as the assistant's turn."""
    prompt = F.when(col(task) == "mcqa", mcqa_prompt(question, options)).when(col(task) == "extqa", extqa_prompt(context, question)).otherwise(absqa_prompt(question, context))
    return F.concat(build_messages(prompt), F.array(message("assistant", col(answer))))


def chat_ml(messages: Column | str) -> Column:
    """The messages in the <|im_start|> layout."""
    return F.array_join(F.transform(col(messages), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def clean_generation(text: Column | str) -> Column:
    """Reasoning blocks (closed, then dangling), left-over reasoning tags and chat control tokens go."""
    t = F.coalesce(col(text), F.lit(""))
    for tag in REASONING[:1]:
        t = F.regexp_replace(F.regexp_replace(t, f"(?is)<{tag}>.*?</{tag}>", ""), f"(?is)<{tag}>.*", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(REASONING)})\b[^>]*>", "")
    return strip(F.regexp_replace(t, rf"<\|im_(?:start|end)\|>(?:{'|'.join(CHAT_ROLES)})?", ""))


def trim_to_span(text: Column | str, max_words: int = 20) -> Column:
    """The first non-empty line without quotes around it, at most max_words words."""
    lines = F.transform(F.split(clean_generation(text), "\n"), lambda x: F.regexp_replace(strip(x), "^[\"'«»\\s]+|[\"'«»\\s]+$", ""))
    first = F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))
    return F.array_join(F.slice(F.split(first, r"(?U)\s+"), 1, max_words), " ")


def letters(text: Column | str, n_choices: Column | int = 5) -> Column:
    """Single capital letters among the first n, sorted and distinct; prose gives false positives, as the faithful form does."""
    n = F.lit(n_choices) if isinstance(n_choices, int) else n_choices
    found = F.regexp_extract_all(F.upper(F.coalesce(col(text), F.lit(""))), F.lit(r"(?U)\b([A-Z])\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.ascii(x) - 65 < n)))


def letters_strict(text: Column | str, n_choices: Column | int = 5) -> Column:
    """Letters only from an answer phrase or a text that is nothing but letters."""
    t = F.coalesce(col(text), F.lit(""))
    only = F.when(F.upper(t).rlike(r"^[\s,;/()A-Z]*$") & ~F.upper(t).rlike("[A-Z]{2}"), t)
    said = F.nullif(F.regexp_extract(t, r"(?i)(?:réponses?|reponses?|answers?)[^:A-Z]*[:\s]+((?:[A-Z](?![\p{L}])[\s,;/et]*)+)", 1), F.lit(""))
    return letters(F.coalesce(said, only, F.lit("")), n_choices)


def gold_letters(text: Column | str) -> Column:
    parts = F.transform(F.split(F.upper(F.coalesce(col(text), F.lit(""))), ","), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^\p{L}+$"))))


def pred_or_raw(pred: Column | str, raw: Column | str) -> Column:
    return F.coalesce(F.nullif(col(pred), F.lit("")), col(raw))


# Rubric axes and the other names a judge may give them.
AXES = {
    "factual": ("factual", "factuality", "fact", "exact", "factual_correctness"), "complete": ("complete", "completeness"),
    "relevance": ("relevance", "relevant", "focus"), "safety": ("safety", "safe", "harmlessness"),
}


def parse_rubric(text: Column | str) -> Column:
    """struct(factual, complete, relevance, safety, composite) of 1..5, or null: JSON, then key by key, then four bare digits."""
    t = F.coalesce(col(text), F.lit(""))
    body = F.regexp_replace(F.regexp_extract(t, r"\{[^{}]+\}", 0), "'", '"')
    fields = F.transform_keys(F.from_json(body, "map<string,string>"), lambda k, _: F.lower(k))
    valid = lambda c: F.when(c.between(1, 5), c)
    whole_number = lambda v: F.coalesce(v.try_cast("double").cast("int"), F.nullif(F.regexp_extract(v, r"\d+", 0), F.lit("")).try_cast("int"))  # noqa: E731  4, 4.0, 4/5
    layer1 = {a: valid(whole_number(F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names]))) for a, names in AXES.items()}
    layer2 = {a: valid(F.nullif(F.regexp_extract(t, rf"(?i){a}[\"']?\s*[:=]\s*[\"']?(\d+)", 1), F.lit("")).cast("int")) for a in AXES}
    digits = F.regexp_extract_all(t, F.lit(r"\b([1-5])\b"), F.lit(1))
    layer3 = {a: F.try_element_at(digits, F.lit(i + 1)).cast("int") for i, a in enumerate(AXES)}

    def whole(layer: dict[str, Column]) -> Column:
        ok = F.lit(True)
        for v in layer.values():
            ok = ok & v.isNotNull()
        mean = sum(list(layer.values())[1:], list(layer.values())[0]) / 4.0
        return F.when(ok, F.struct(*[v.alias(a) for a, v in layer.items()], mean.alias("composite")))

    return F.coalesce(whole(layer1), whole(layer2), whole(layer3))


def parse_verdict(text: Column | str) -> Column:
    """A, B, TIE or null."""
    t = F.upper(F.coalesce(col(text), F.lit("")))
    said = F.regexp_extract(t, r"\"?WINNER\"?\s*[:=]\s*\"?\s*(TIE|ÉGALITÉ|EGALITE|DRAW|A|B)\b", 1)
    bare = F.regexp_extract(t, r"\b(TIE|A|B)\b", 1)
    got = F.coalesce(F.nullif(said, F.lit("")), F.nullif(bare, F.lit("")))
    return F.when(got.isin("ÉGALITÉ", "EGALITE", "DRAW"), "TIE").otherwise(got)


def verdict_reason(text: Column | str) -> Column:
    """The reason that comes with a verdict, empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(col(text), F.lit("")), r'(?is)"?reason"?\s*[:=]\s*"([^"]*)"', 1))


def combine_passes(ab: Column | str, ba: Column | str) -> Column:
    """struct(winner, consistent) of a duel judged in both orders; slot A holds the challenger in the first."""
    first = F.when(col(ab) == "A", "challenger").when(col(ab) == "B", "opponent").when(col(ab) == "TIE", "tie")
    second = F.when(col(ba) == "B", "challenger").when(col(ba) == "A", "opponent").when(col(ba) == "TIE", "tie")
    winner = F.when(first.isNull(), second).when(second.isNull(), first).when(first == second, first).otherwise(F.lit("tie"))
    return F.struct(winner.alias("winner"), F.coalesce(first == second, F.lit(False)).alias("consistent"))


def classify_failure(pred: Column, gold: Column, cleaned: Column | str) -> Column:
    """The error class of a multiple-choice answer; pred and gold are arrays of letters."""
    right = F.size(F.array_intersect(pred, gold))
    return (
        F.when(F.coalesce(col(cleaned), F.lit("")) == "", "empty_generation").when(F.size(pred) == 0, "format_failure")
        .when((right == F.size(pred)) & (right == F.size(gold)), "correct").when(right == 0, "all_wrong")
        .when((right == F.size(pred)) & (right < F.size(gold)), "under_predict").when((right == F.size(gold)) & (right < F.size(pred)), "over_predict").otherwise("partial_match")
    )


def route(pred: Column | str, raw: Column | str, n_choices: Column | int = 5) -> Column:
    """struct(route, pred_judged): answers that need no judge, are recovered by parsing again, or wait for one."""
    again = F.array_join(letters(clean_generation(raw), n_choices), ",")
    empty = F.coalesce(col(pred), F.lit("")) == ""
    said = clean_generation(raw) != ""
    where = F.when(~empty | ~said, "done").when(again != "", "recovered").otherwise("judge")
    return F.struct(where.alias("route"), F.when(empty & said & (again != ""), again).alias("pred_judged"))


def model_group(name: Column | str, registry: dict[str, str], default: str = "excluded") -> Column:
    """The group of a model by the longest registered start of its name."""
    out = F.lit(default)
    for start in sorted(registry, key=len):
        out = F.when(col(name).startswith(start), registry[start]).otherwise(out)
    return out
