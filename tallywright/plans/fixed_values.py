"""Values that the reports must carry unchanged."""

# Phrases that mark an analyst's vacancy, in the case searched for.
TITLE_PHRASES = ("Аналитик данных", "Системный аналитик")

# Labels and column names of the bonus report.
BONUS_LABELS = ("Получили бонусы", "Не получали бонусы")
BONUS_STATUS = "статус_бонусов"

# Sign-in flags in order of precedence, with their labels.
SIGN_IN_LABELS = (
    ("autho_vk", "ВКонтакте"),
    ("autho_ok", "Одноклассники"),
    ("autho_tg", "Telegram"),
    ("autho_yandex", "Яндекс"),
    ("autho_google", "Google"),
)
NO_SIGN_IN = "Без авторизации через соцсети"
NETWORK = "социальная_сеть"

# Columns shared by the bonus and the sign-in report.
DONOR_COUNT = "количество_доноров"
MEAN_DONATIONS = "среднее_количество_донаций"

# Frequency bands of repeat donors.
FREQUENCY_BANDS = ((2, 3, "2-3 донации"), (4, 5, "4-5 донаций"))
FREQUENCY_OTHER = "6 и более донаций"

# Period of the monthly report, both days included.
PERIOD = ("2022-01-01", "2023-12-31")
