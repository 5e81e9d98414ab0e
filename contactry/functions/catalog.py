"""Phrases of the demand catalog and query templates. Operators take them as parameters."""

# Intents (phrase, intent, priority).
INTENTS = (
    ("ищем подрядчика", "vendor_search", 100),
    ("ищу студию", "vendor_search", 100),
    ("нужен продакшн", "vendor_search", 98),
    ("посоветуйте подрядчика", "recommendation", 96),
    ("порекомендуйте студию", "recommendation", 96),
    ("кто может сделать", "vendor_search", 92),
    ("нужно сделать", "brief", 88),
    ("ищем исполнителя", "vendor_search", 94),
    ("запрос предложений", "tender", 100),
    ("тендер", "tender", 100),
    ("собираем сметы", "brief", 90),
    ("нужна оценка стоимости", "brief", 86),
)
# Services (category, phrases).
SERVICES = (
    ("business_video", ("видеоролик для компании", "корпоративное видео", "видеоконтент для бизнеса")),
    ("animation", ("анимационный ролик", "2D анимация для бизнеса", "3D ролик для компании", "нейроанимация")),
    ("explainer", ("объясняющий ролик", "explainer video", "визуализация сложного продукта")),
    ("pharma", ("фармацевтический ролик", "анимация механизма действия препарата", "ролик для врачей", "ролик для пациентов")),
    ("safety", ("ролик по охране труда", "анимация по промышленной безопасности", "видеоинструктаж по безопасности", "разбор производственного инцидента видео")),
    ("learning", ("анимация для электронного курса", "обучающий ролик для сотрудников", "микрообучение видео", "контент для корпоративного университета")),
    ("onboarding", ("видео для онбординга сотрудников", "welcome ролик для сотрудников", "адаптационный курс видео")),
    ("internal_comms", ("ролик для внутренних коммуникаций", "корпоративная культура видео", "видео обращение руководителя")),
    ("hr_brand", ("ролик для бренда работодателя", "HR видео", "видео о профессиях компании")),
    ("marketing", ("рекламный анимационный ролик", "видео для запуска продукта", "брендовый видеоконтент")),
    ("events", ("ролик для конференции", "заставка для мероприятия", "визуальный контент для стенда", "видео для выставки")),
    ("mascot", ("создать маскота бренда", "анимировать корпоративного персонажа", "персонаж для рекламной кампании")),
    ("industrial", ("визуализация технологического процесса", "анимация работы оборудования", "техническая 3D анимация")),
    ("sales", ("продающий видеоролик B2B", "видео для отдела продаж", "ролик для презентации продукта")),
    ("public_sector", ("социальный видеоролик", "просветительская анимация", "ролик для госкомпании")),
)
# English queries (category, query, intent).
ENGLISH = (
    ("business_video", '"looking for" "video production studio"', "vendor_search"),
    ("animation", '"looking for" "animation studio"', "vendor_search"),
    ("explainer", '"need an explainer video"', "brief"),
    ("pharma", '"pharma animation studio" recommendation', "recommendation"),
    ("safety", '"safety training animation" vendor', "vendor_search"),
    ("learning", '"animation for e-learning" contractor', "vendor_search"),
    ("onboarding", '"employee onboarding video" agency', "vendor_search"),
    ("events", '"event screen content" production studio', "vendor_search"),
    ("mascot", '"brand mascot animation" studio', "vendor_search"),
    ("industrial", '"industrial process animation" vendor', "vendor_search"),
)
# Sites of the social and forum queries, intents and priorities of the derived queries.
SOCIAL_SITES = ("t.me", "vk.com", "tenchat.ru", "threads.net")
FORUM_SITES = ("vc.ru", "habr.com", "pikabu.ru", "otvet.mail.ru", "reddit.com")
SOCIAL_PRIORITY, FORUM_PRIORITY, ENGLISH_PRIORITY = 82, 76, 72
# Strata of the daily sample and the most that each takes.
STRATA = (("core", 8), ("social", 8), ("forum-ru", 6), ("english", 4))
CORE_PRIORITY = 98
# Templates of search queries; {c} is the company, {p} the person, {r} the roles joined by OR.
COMPANY_TEMPLATES = (
    '"{c}" официальный сайт контакты',
    '"{c}" руководство директор ({r})',
    '"{c}" email телефон',
    '"{c}" интервью вебинар конференция',
    '"{c}" назначен назначена руководитель',
    '"{c}" site:t.me OR site:vk.com',
    '"{c}" site:youtube.com OR site:rutube.ru',
    '"{c}" site:threads.net OR site:instagram.com',
    '"{c}" site:tenchat.ru OR site:linkedin.com',
    '"{c}" Telegram OR ВКонтакте OR TenChat',
)
PERSON_TEMPLATES = (
    '"{p}" "{c}"',
    '"{p}" "{c}" email',
    '"{p}" "{c}" Telegram',
    '"{p}" "{c}" site:t.me OR site:vk.com',
    '"{p}" "{c}" site:tenchat.ru OR site:linkedin.com',
    '"{p}" "{c}" site:threads.net OR site:instagram.com',
    '"{p}" "{c}" интервью OR конференция OR вебинар',
    '"{p}" "{c}" site:youtube.com',
)
NEWS_TEMPLATES = (
    '"{c}"', '"{c}" директор', '"{c}" руководитель', '"{c}" назначен OR назначена', '"{c}" возглавил OR возглавила', '"{c}" интервью',
    '"{c}" конференция OR вебинар',
)
EVENT_TEMPLATES = ('"{c}"', '"{c}" (director OR CEO OR interview)', '"{c}" (appointed OR conference)')
PAID_TEMPLATES = ('"{c}" официальный сайт контакты руководство', '"{c}" ({roles}) email Telegram')
# How many demand queries a provider gets.
BUDGETS = (("google_news", 10), ("gdelt", 6), ("hacker_news", 8), ("stack_exchange", 5), ("youtube", 8))
# Roles looked for around names.
ROLES = (
    "генеральный директор", "ceo", "коммерческий директор", "директор по маркетингу", "маркетинг-директор", "cmo",
    "директор по персоналу", "hrd", "hr director", "директор по обучению", "руководитель корпоративного университета",
    "руководитель l&d", "директор по коммуникациям", "pr директор", "руководитель охраны труда", "hse",
    "директор по производственной безопасности", "руководитель digital", "директор по инновациям", "бренд-директор",
    "креативный директор", "собственник", "основатель", "co-founder", "управляющий партнёр",
)
# Letters with several Latin ones, and the others.
DIGRAPHS = (("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"), ("я", "ya"))
LETTERS = ("абвгдеёзийклмнопрстуфыэьъ", "abvgdeeziyklmnoprstufye")
# Hosts that are no official site.
NON_OFFICIAL_HOSTS = (
    "2gis.ru", "avito.ru", "facebook.com", "instagram.com", "linkedin.com", "list-org.com", "ok.ru", "t.me", "tenchat.ru", "threads.net",
    "vk.com", "wikipedia.org", "youtube.com", "zachestnyibiznes.ru",
)
