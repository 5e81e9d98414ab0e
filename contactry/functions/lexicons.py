"""Default registries and word lists. Operators take them as parameters."""

# Fixed values.
GENERIC_MAILBOXES = (
    "admin", "contact", "contacts", "career", "careers", "hello", "help", "hr", "info", "jobs", "mail", "marketing",
    "office", "press", "pr", "recruitment", "sales", "secretary", "support", "team",
)
GENERIC_PREFIX = "^(info|office|mail|hello|contact|sales)[._-]"
PLATFORM_HOSTS = (
    ("telegram", ("t.me", "telegram.me")),
    ("vk", ("vk.com",)),
    ("youtube", ("youtube.com", "youtu.be")),
    ("threads", ("threads.net",)),
    ("instagram", ("instagram.com",)),
    ("tenchat", ("tenchat.ru",)),
    ("linkedin", ("linkedin.com",)),
    ("rutube", ("rutube.ru",)),
    ("github", ("github.com",)),
)
EMAIL = "(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}"
PHONE = "\\+?[0-9][0-9\\s().-]{7,}[0-9]"
#: Cyrillic alternatives are met in decoded paths only: a browser escapes them.
USEFUL_PATH = "(?i)contact|team|about|company|people|staff|management|руковод|команд|контакт|о[-_]?компан|press|media|news|blog|author|speaker|expert|partner|procurement|tender|vacanc|career|job|event|conference|webinar|document|file|upload|\\.pdf"
HIGH_VALUE_PATH = "(?i)contact|team|people|staff|management|руковод|команд|speaker|expert|author|\\.pdf"
BLOCKED_PATH = "(?i)login|signin|cart|checkout|privacy|policy|cookie|terms|личн"
OFFICIAL_SOURCES = ("website", "pdf", "rss")
WEB_SOURCES = ("search", "searxng", "google_news", "gdelt", "github", "gemini", "llm")
DELIVERABILITY_RANK = (("undeliverable", 0), ("unknown", 1), ("risky", 2), ("deliverable", 3))
INTENT_TERMS = (
    "ищем", "ищу", "нужен", "нужна", "нужно", "посоветуйте", "порекомендуйте", "подрядчик", "исполнитель", "студия",
    "продакшн", "тендер", "бриф", "смет", "стоимост", "looking for", "need a", "vendor", "contractor", "recommend",
)
FIT_TERMS = (
    "видео", "ролик", "анимац", "нейроанимац", "explainer", "video", "motion", "маскот", "персонаж", "онбординг",
    "обучен", "охрана труда", "безопасност", "фарма", "препарат", "врач", "конференц", "выставк", "корпоративн",
    "e-learning", "industrial",
)
STRONG_TERMS = ("тендер", "запрос предложений", "бюджет", "смет", "техническое задание", "тз", "дедлайн", "срок", "бриф", "rfp")
NEGATIVE_TERMS = (
    "ищу работу", "вакансия", "резюме", "курс", "обучение профессии", "как сделать самому", "шаблон бесплатно",
    "скачать бесплатно", "торрент", "job opening", "hiring animator", "tutorial",
)
QUERY_STOP_WORDS = ("ищем", "ищу", "нужен", "нужна", "нужно", "looking", "with", "site")
#: First and last name with or without patronymic, last name and initials, initials and last name.
PERSON = (
    "(?:[А-ЯЁ][а-яё-]{1,30}\\s+[А-ЯЁ][а-яё-]{1,30}(?:\\s+[А-ЯЁ][а-яё-]{1,30})?|[А-ЯЁ][а-яё-]{1,30}\\s+[А-ЯЁ]\\.(?:\\s?[А-ЯЁ]\\.)?"
    "|[А-ЯЁ]\\.(?:\\s?[А-ЯЁ]\\.)?\\s+[А-ЯЁ][а-яё-]{1,30})"
)
#: Reasons of the demand score, as the reports show them; the services are not named after a company.
DEMAND_REASONS = {
    "intent": "+ намерение: ", "fit": "+ услуги: ", "strong": "+ коммерческая конкретика: ", 3: "+ опубликовано за 3 дня", 14: "+ опубликовано за 14 дней",
    45: "+ опубликовано за 45 дней", "author": "+ указан автор или канал", "kind": "+ целевой тип: ", "negative": "− нерелевантно: ",
    "channel": "+ есть прямой публичный канал",
}
