"""Fixed values of the domain: word lists, units, headings, limits. All of them are parameters' defaults."""

# Directed alias entries.
ALIASES = {
    "фгдс": ["эгдс"],
    "эгдс": ["фгдс"],
    "экг": ["электрокардиография"],
    "эхокг": ["эхокардиография"],
    "лпнп": ["ldl"],
    "лпвп": ["hdl"],
    "ldl": ["лпнп"],
    "hdl": ["лпвп"],
    "ттг": ["tsh"],
    "птг": ["pth"],
    "tsh": ["ттг"],
    "pth": ["птг"],
    "psa": ["пса"],
    "пса": ["psa"],
}

# Stop words of tags.
STOPWORDS = [
    "для", "при", "или", "что", "это", "как", "его", "ее", "из", "по", "на", "от", "до", "за", "без", "под", "над", "про", "через", "между", "около", "вдоль", "после", "the", "and", "for", "with", "not", "are", "was", "were",
]

# Units of measurement, whole and as patterns.
UNITS = [
    "кг", "г", "мг", "мкг", "нг", "л", "мл", "мм", "см", "м", "рт.ст", "мс", "мсек", "сек", "мин", "ч", "%", "уд/мин", "ммоль/л", "мкмоль/л", "нг/мл", "пг/мл", "ед/л", "ме/мл", "мме/мл", "мкме/мл", "mg", "ml", "kg", "cm", "mm", "mg/ml", "ml/kg", "ng/ml", "pg/ml",
]
UNIT_PATTERNS = ["^(мк)?ме/мл$", "^(мк)?моль/л$", "^(пг|нг|мг|мкг)/мл$", "^ед/л$"]

# Document categories.
CATEGORIES = ["Консультация", "Анализы", "Диагноз", "Исследование", "Операция", "Выписка"]

# Headings of administrative sections.
ADMIN_HEADINGS = [
    "пациент",
    "информация о пациенте",
    "информация о заказе",
    "информация о лаборатории и заказе",
    "информация о пациенте и заказе",
    "примечания",
    "подпись и примечания",
    "подпись и заключение",
    "сведения об обследовании",
    "информация об организации",
    "дополнительно",
    "дополнительная информация",
    "аббревиатуры",
    "metadata",
    "учреждение",
    "данные пациента",
    "врач",
    "информированное согласие",
    "реквизиты",
]

# Date markers and file name patterns.
DATE_EXCLUDED = ["рождения", "отправки", "печати"]
DATE_FALLBACK = ["валидации", "заказа"]
FILENAME_DATES = [r"^(\d{4}-\d{2}-\d{2})[_\-]", r"(\d{8})$"]

# Characters that the tag tokenizer strips from a token's ends, and those that no tag holds inside.
EDGE_CHARS = ".,;:()[]!?\"'«»"
INNER_CHARS = ",.:;!?\"'"

# The mark in the middle of a cut excerpt.
CUT_MARK = "\n…[truncated]…\n"

# Combining marks that the full-text index drops.
COMBINING_MARKS = (
    "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311"
    "\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
)
