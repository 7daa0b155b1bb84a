"""Fixed values of the news domain. They are data, not logic, and are kept together in their natural order."""

from __future__ import annotations

# Limits and thresholds.
MAX_ITEMS_PER_FEED = 5
SOURCES_PER_TICK = 2
TICK_MINUTES = 15
MIN_CONTENT_CHARS = 100
MAX_ARTICLE_AGE_DAYS = 2
RETENTION_DAYS = 7
TITLE_LOOKBACK_HOURS = 24
TITLE_THRESHOLD = 85
MODEL_BATCH_SIZE = 5
REFRESH_TOKEN_DAYS = 30
DEFAULT_LIMIT = 10
MAX_LIMIT = 100
DEFAULT_PER_CATEGORY = 5
MAX_PER_CATEGORY = 50

# Categories, in display order.
CATEGORIES = ["Politics", "Crime", "Technology", "Sports", "Entertainment", "Business", "General"]
DEFAULT_CATEGORY = "General"

# Languages, in rotation order.
LANGUAGE_CYCLE = ["english", "odia", "bengali"]
DEFAULT_LANGUAGE = "english"

# Fallback texts.
UNTITLED = "Untitled article"
NO_SUMMARY = "Summary unavailable. Original content could not be summarized."

# Notification fields.
PLACEHOLDER_IMAGE = "https://placehold.co/600x400"
NOTIFICATION_TYPE = "new_article"
CLICK_ACTION = "FLUTTER_NOTIFICATION_CLICK"
BODY_LIMIT = 150
BODY_CUT = 147

# News sources as (language, key, source_name, base_url, rss_url, url_patterns), in rotation order.
SOURCES = [
    ("english", "timesofindia", "Times of India", "https://timesofindia.indiatimes.com",
     "https://timesofindia.indiatimes.com/rssfeedstopstories.cms",
     ["https://timesofindia.indiatimes.com/india/", "https://timesofindia.indiatimes.com/world/",
      "https://timesofindia.indiatimes.com/business/"]),
    ("english", "thehindu", "The Hindu", "https://www.thehindu.com",
     "https://www.thehindu.com/feeder/default.rss",
     ["https://www.thehindu.com/news/national/", "https://www.thehindu.com/news/international/"]),
    ("english", "hindustantimes", "Hindustan Times", "https://www.hindustantimes.com",
     "https://www.hindustantimes.com/feeds/rss/latest/rssfeed.xml",
     ["https://www.hindustantimes.com/india-news/", "https://www.hindustantimes.com/world-news/"]),
    ("english", "ndtv_english", "NDTV", "https://www.ndtv.com",
     "https://feeds.feedburner.com/ndtvnews-top-stories", ["https://www.ndtv.com/india-news/"]),
    ("english", "news18_english", "News18 English", "https://www.news18.com",
     "https://www.news18.com/commonfeeds/v1/eng/rss/india.xml", ["https://www.news18.com/india/"]),
    ("english", "deccanherald", "Deccan Herald", "https://www.deccanherald.com",
     "https://www.deccanherald.com/stories.rss", ["https://www.deccanherald.com/india/"]),
    ("english", "indianexpress", "Indian Express", "https://indianexpress.com",
     "https://indianexpress.com/section/trending/feed/", ["https://indianexpress.com/article/trending/"]),
    ("english", "indiatoday", "India Today", "https://www.indiatoday.in",
     "https://www.indiatoday.in/rss/1206578", ["https://www.indiatoday.in/india/story"]),
    ("odia", "sambad_odia", "Sambad", "https://sambad.in", "https://sambad.in/rss", ["https://sambad.in/"]),
    ("odia", "prameya_odia", "Prameya", "https://www.prameya.com",
     "https://www.prameya.com/feed", ["https://www.prameya.com/"]),
    ("odia", "khabarodisha", "Khabar Odisha", "https://khabarodisha.com",
     "https://khabarodisha.com/RSS/Feed/Khabar-Odisha-Special-and-Odisha-News-Detail",
     ["https://khabarodisha.com/"]),
    ("odia", "odia_oneindia", "Oneindia Odia", "https://odia.oneindia.com",
     "https://odia.oneindia.com/rss/feeds/oneindia-odia-fb.xml", ["https://odia.oneindia.com/"]),
    ("odia", "kanaknews", "Kanak News", "https://kanaknews.com",
     "https://kanaknews.com/rss", ["https://kanaknews.com/"]),
    ("odia", "dharitri", "Dharitri", "https://www.dharitri.com",
     "https://www.dharitri.com/rss", ["https://www.dharitri.com/"]),
    ("odia", "thesamaja", "The Samaja", "https://thesamaja.in",
     "https://samajalive.in/feed", ["https://thesamaja.in/"]),
    ("bengali", "zee_bengali", "Zee 24 Ghanta", "https://zeenews.india.com/bengali",
     "http://zeenews.india.com/bengali/rssfeed/nation.xml", ["/bengali/nation/", "/bengali/state/"]),
    ("bengali", "abp_ananda", "ABP Ananda", "https://bengali.abplive.com",
     "https://bengali.abplive.com/home/feed", ["https://bengali.abplive.com/news/"]),
    ("bengali", "sangbadpratidin", "Sangbad Pratidin", "https://www.sangbadpratidin.in",
     "https://www.sangbadpratidin.in/feed/", ["https://www.sangbadpratidin.in/"]),
    ("bengali", "news18_bengali", "News18 Bengali", "https://bengali.news18.com",
     "https://bengali.news18.com/commonfeeds/v1/ben/rss/trending.xml", ["https://bengali.news18.com/news/"]),
    ("bengali", "eisamay", "Eisamay", "https://eisamay.com",
     "https://eisamay.com/stories.rss", ["https://eisamay.com/"]),
    ("bengali", "tv9bangla", "TV9 Bangla", "https://tv9bangla.com",
     "https://tv9bangla.com/feed", ["https://tv9bangla.com/"]),
    ("bengali", "uttarbangasambad", "Uttar Bangla Sambad", "https://uttarbangasambad.com",
     "https://uttarbangasambad.com/feed/", ["https://uttarbangasambad.com/"]),
]

# Instruction texts per language; {categories} stands for the category list.
PROMPTS = {
    "english": """You are a professional news writer. For each article:
1. Create a concise title with a maximum of 8 words.
2. Write a short factual summary with at least 50 words in English.
3. Categorize the article using exactly one of: {categories}.
4. Preserve factual accuracy.

Return a JSON object with an "articles" key that contains an array of objects with:
- source_url
- title
- content
- category""",
    "odia": """You are a professional Odia-language (ଓଡ଼ିଆ) news writer. For each article:
1. Write a concise title in Odia script (ଓଡ଼ିଆ), maximum 8 Odia words.
2. Write a factual summary in Odia script with at least 50 Odia words.
3. Categorize the article using exactly one of: {categories}.
4. Preserve factual accuracy. Output ONLY Odia script for title and content.

Return a JSON object with an "articles" key that contains an array of objects with:
- source_url
- title  (in Odia script)
- content (in Odia script)
- category""",
    "bengali": """You are a professional Bengali-language (বাংলা) news writer. For each article:
1. Write a concise title in Bengali script (বাংলা), maximum 8 Bengali words.
2. Write a factual summary in Bengali script with at least 50 Bengali words.
3. Categorize the article using exactly one of: {categories}.
4. Preserve factual accuracy. Output ONLY Bengali script for title and content.

Return a JSON object with an "articles" key that contains an array of objects with:
- source_url
- title   (in Bengali script)
- content (in Bengali script)
- category""",
}
RETRY_SUFFIX = (
    "\n\nReturn only valid JSON. Do not include markdown, commentary, or any text before or after the JSON."
)
PROVIDERS = {"english": "openrouter", "other": "sarvam"}
