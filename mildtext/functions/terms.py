"""Built-in term lists of the delete rewriter."""

from __future__ import annotations

# The built-in lexicon per language (a moderation deny list).
BUILTIN_TERMS: dict[str, tuple[str, ...]] = {
    "en": (
        "fuck", "shit", "damn", "ass", "bitch", "bastard", "dick", "crap",
        "piss", "hell", "slut", "whore", "idiot", "stupid", "moron", "dumb",
        "retard", "nigger", "faggot", "cunt", "kill", "hate", "ugly",
        "loser", "suck", "pathetic", "trash", "worthless", "disgusting",
        "horrible", "terrible", "awful", "scum", "pig", "die", "rape",
        "fucking", "shitty", "bullshit", "asshole", "motherfucker", "dumbass",
        "jackass", "dickhead", "goddamn", "crappy", "bitchy", "slutty",
    ),
    "es": (
        "mierda", "puta", "joder", "cono", "gilipollas", "cabron", "imbecil",
        "estupido", "idiota", "pendejo", "culero", "chingar", "verga",
        "marica", "zorra", "basura", "cerdo", "asqueroso", "maldito",
        "pinche", "hijueputa", "carajo", "tonto", "baboso", "mamon",
    ),
    "hi": (
        "madarchod", "bhenchod", "chutiya", "gandu", "randi", "haramzada",
        "harami", "kutta", "kamine", "saala", "bhadwa", "kutte", "kamina",
        "gadha", "ullu", "bakwaas", "bewakoof", "pagal", "nalayak",
        "मादरचोद", "भेनचोद", "चूतिया", "गांडू", "रंडी", "हरामजादा",
        "हरामी", "कुत्ता", "कमीना", "साला", "भड़वा", "गधा", "उल्लू",
        "बकवास", "बेवकूफ", "पागल", "नालायक",
    ),
}
