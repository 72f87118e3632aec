"""Word lists and lookup tables, in natural order."""

STOPWORDS = (
    "a an the and or but in on at to for of with by from is it this that are was were be been being have has had do "
    "does did will would could should may might shall can not no so if as its my we they he she i you me him her us "
    "them our your his their what which who whom how when where why all each every both few more most other some such "
    "than too very just about above after again also am any because before below between during into out over own "
    "same then through under until up while"
).split()

LANGUAGES = {
    "English": "the and is in to of it that was for on are with as at this but not you from",
    "French": "le la les de des du un une et est en que qui dans pour pas sur au avec ce",
    "German": "der die das und ist ein eine nicht mit auf den dem des sich von zu auch es ich aber",
    "Spanish": "el la los las de en que es un una por del con para como pero su al se no",
    "Italian": "il lo la gli le di che non un una per sono con del della dei anche alla nel ma",
    "Portuguese": "os as um uma que em para com por mais mas como dos das seu sua ou quando muito nos",
    "Dutch": "de het een van en in is dat op te zijn voor niet met ook maar nog aan dit bij",
}
LANGUAGE_CODES = {"English": "en", "French": "fr", "German": "de", "Spanish": "es", "Italian": "it", "Portuguese": "pt", "Dutch": "nl"}

MISSPELLINGS = {
    "teh": "the", "recieve": "receive", "occured": "occurred", "seperate": "separate", "definately": "definitely",
    "accomodate": "accommodate", "occurence": "occurrence", "neccessary": "necessary", "embarass": "embarrass",
    "goverment": "government", "enviroment": "environment", "arguement": "argument", "begining": "beginning",
    "beleive": "believe", "calender": "calendar", "commitee": "committee", "concious": "conscious",
    "desparate": "desperate", "diffrence": "difference", "existance": "existence", "foriegn": "foreign",
    "grammer": "grammar", "harrass": "harass", "immediatly": "immediately", "independant": "independent",
    "jeopardize": "jeopardize", "knowlege": "knowledge", "liason": "liaison", "maintenence": "maintenance",
    "millenium": "millennium", "noticable": "noticeable", "persistant": "persistent", "publically": "publicly",
    "recomend": "recommend", "refered": "referred", "succesful": "successful", "tommorow": "tomorrow",
    "untill": "until", "wierd": "weird", "writting": "writing",
}

POSITIVE = "good great excellent amazing wonderful fantastic love best happy beautiful awesome perfect brilliant outstanding superb nice pleasant enjoy recommend impressive delightful positive success".split()
NEGATIVE = "bad terrible awful horrible worst hate poor disappointing ugly nasty disgusting fail boring annoying stupid useless broken sad angry frustrating negative problem error wrong".split()

KNOWLEDGE = [  # key, answer, confidence, source
    ("capital of france", "Paris", 1.0, "Geography KB"),
    ("capital of japan", "Tokyo", 1.0, "Geography KB"),
    ("capital of germany", "Berlin", 1.0, "Geography KB"),
    ("capital of australia", "Canberra", 1.0, "Geography KB"),
    ("capital of brazil", "Brasília", 1.0, "Geography KB"),
    ("population of japan", "125 million (2024 est.)", 0.95, "Demographics KB"),
    ("population of india", "1.44 billion (2024 est.)", 0.95, "Demographics KB"),
    ("speed of light", "299,792,458 meters per second", 1.0, "Physics KB"),
    ("boiling point of water", "100°C (212°F) at standard atmospheric pressure", 1.0, "Chemistry KB"),
    ("largest ocean", "Pacific Ocean (165.25 million km²)", 1.0, "Geography KB"),
    ("python creator", "Guido van Rossum, first released in 1991", 1.0, "Technology KB"),
    ("transformer architecture", "Introduced in 'Attention Is All You Need' (Vaswani et al., 2017) by Google Brain", 1.0, "Technology KB"),
]

RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.79, "JPY": 149.50, "AUD": 1.53, "CAD": 1.36, "CHF": 0.88, "CNY": 7.24, "INR": 83.12, "KRW": 1325.50, "BRL": 4.97, "MXN": 17.15, "SGD": 1.34, "HKD": 7.82, "SEK": 10.42}

STOCKS = [  # symbol, name, price, change, market cap
    ("AAPL", "Apple Inc.", 189.84, 1.23, "2.95T"),
    ("GOOGL", "Alphabet Inc.", 141.80, -0.54, "1.76T"),
    ("MSFT", "Microsoft Corp.", 415.20, 2.10, "3.08T"),
    ("AMZN", "Amazon.com Inc.", 178.25, 0.87, "1.86T"),
    ("NVDA", "NVIDIA Corp.", 875.35, 12.40, "2.16T"),
    ("TSLA", "Tesla Inc.", 238.45, -3.20, "758B"),
    ("META", "Meta Platforms", 505.75, 4.50, "1.29T"),
]

CITIES = {
    "tokyo": (35.6762, 139.6503), "paris": (48.8566, 2.3522), "london": (51.5074, -0.1278), "new york": (40.7128, -74.0060),
    "sydney": (-33.8688, 151.2093), "berlin": (52.5200, 13.4050), "mumbai": (19.0760, 72.8777), "dubai": (25.2048, 55.2708),
    "toronto": (43.6532, -79.3832), "singapore": (1.3521, 103.8198), "seoul": (37.5665, 126.9780), "beijing": (39.9042, 116.4074),
    "cairo": (30.0444, 31.2357), "moscow": (55.7558, 37.6173), "rome": (41.9028, 12.4964), "san francisco": (37.7749, -122.4194),
    "los angeles": (34.0522, -118.2437), "chicago": (41.8781, -87.6298),
}

WEATHER = ["sunny", "cloudy", "rainy", "partly cloudy", "snowy", "windy", "foggy"]
HTTP_CODES = [200, 200, 200, 200, 301, 302, 403, 404, 500]
WEBHOOK_CODES = [200, 200, 200, 200, 201, 202, 400, 500]
IP_COUNTRIES = ["United States", "United Kingdom", "Germany", "Japan", "Canada", "France", "Australia", "Brazil", "India", "Netherlands", "South Korea", "Singapore", "Sweden", "Switzerland", "Ireland"]
IP_CITIES = ["San Francisco", "London", "Berlin", "Tokyo", "Toronto", "Paris", "Sydney", "Sao Paulo", "Mumbai", "Amsterdam", "Seoul", "Singapore", "Stockholm", "Zurich", "Dublin"]
FEED_TITLES = [
    "Breaking: Major Update Released", "New Study Reveals Surprising Findings", "Tech Industry Report Q1 2026", "Opinion: The Future of AI Development",
    "Market Analysis: Trends to Watch", "Interview with Industry Leader", "Product Review: Latest Innovations", "Research Paper: Novel Approach Demonstrated",
    "Conference Recap: Key Takeaways", "Guide: Best Practices for 2026",
]
RESPONSE_BODIES = [
    '{"message":"OK","data":{"id":1,"status":"active"}}',
    '{"result":"success","items":[{"name":"item1"},{"name":"item2"}]}',
    '{"status":"healthy","version":"2.1.0","uptime_hours":720}',
    '{"users":150,"active":98,"timestamp":"2026-01-15T10:30:00Z"}',
    '{"products":[{"id":101,"name":"Widget","price":29.99}]}',
]
SEARCH_DOMAINS = ["en.wikipedia.org", "arxiv.org", "nature.com", "sciencedirect.com", "medium.com", "github.com", "stackoverflow.com", "nytimes.com", "bbc.com", "reuters.com"]
SEARCH_SOURCES = ["Wikipedia", "News", "Blog", "Academic", "Forum"]

PHRASES = {  # phrase: language: translation
    "hello": {"fr": "bonjour", "es": "hola", "de": "hallo", "ja": "こんにちは", "it": "ciao", "pt": "olá", "zh": "你好", "ko": "안녕하세요", "ru": "привет"},
    "hello world": {"fr": "bonjour le monde", "es": "hola mundo", "de": "hallo welt", "ja": "ハローワールド", "it": "ciao mondo"},
    "good morning": {"fr": "bonjour", "es": "buenos días", "de": "guten morgen", "ja": "おはようございます", "it": "buongiorno"},
    "thank you": {"fr": "merci", "es": "gracias", "de": "danke", "ja": "ありがとう", "it": "grazie", "pt": "obrigado"},
    "how are you": {"fr": "comment allez-vous", "es": "¿cómo estás?", "de": "wie geht es Ihnen", "ja": "お元気ですか"},
    "goodbye": {"fr": "au revoir", "es": "adiós", "de": "auf wiedersehen", "ja": "さようなら", "it": "arrivederci"},
    "the weather is nice today": {"fr": "le temps est beau aujourd'hui", "es": "el clima está agradable hoy", "de": "das Wetter ist heute schön"},
}
LANGUAGE_NAMES = {"en": "English", "fr": "French", "es": "Spanish", "de": "German", "ja": "Japanese", "it": "Italian", "pt": "Portuguese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "ru": "Russian"}

UNITS = [  # from, to, before, times, over, after: (value + before) * times / over + after
    ("celsius", "fahrenheit", 0.0, 9.0, 5.0, 32.0),
    ("fahrenheit", "celsius", -32.0, 5.0, 9.0, 0.0),
    ("celsius", "kelvin", 0.0, 1.0, 1.0, 273.15),
    ("kelvin", "celsius", -273.15, 1.0, 1.0, 0.0),
    ("fahrenheit", "kelvin", -32.0, 5.0, 9.0, 273.15),
    ("kelvin", "fahrenheit", -273.15, 9.0, 5.0, 32.0),
    ("km", "miles", 0.0, 0.621371, 1.0, 0.0),
    ("miles", "km", 0.0, 1.60934, 1.0, 0.0),
    ("meters", "feet", 0.0, 3.28084, 1.0, 0.0),
    ("feet", "meters", 0.0, 0.3048, 1.0, 0.0),
    ("km", "meters", 0.0, 1000.0, 1.0, 0.0),
    ("meters", "km", 0.0, 1.0, 1000.0, 0.0),
    ("miles", "feet", 0.0, 5280.0, 1.0, 0.0),
    ("feet", "miles", 0.0, 1.0, 5280.0, 0.0),
    ("kg", "lbs", 0.0, 2.20462, 1.0, 0.0),
    ("lbs", "kg", 0.0, 0.453592, 1.0, 0.0),
    ("kg", "grams", 0.0, 1000.0, 1.0, 0.0),
    ("grams", "kg", 0.0, 1.0, 1000.0, 0.0),
    ("lbs", "ounces", 0.0, 16.0, 1.0, 0.0),
    ("ounces", "lbs", 0.0, 1.0, 16.0, 0.0),
]

ZONES = {"est": "America/New_York", "cst": "America/Chicago", "mst": "America/Denver", "pst": "America/Los_Angeles", "gmt": "Europe/London", "utc": "UTC", "cet": "Europe/Berlin", "jst": "Asia/Tokyo", "ist": "Asia/Kolkata", "aest": "Australia/Sydney", "kst": "Asia/Seoul", "cst_china": "Asia/Shanghai", "sgt": "Asia/Singapore"}

TRANSCRIPTS = {  # Fixed values. Word in the source's name: text, seconds, segments (start, end, text)
    "meeting": (
        "Good morning everyone. Let's start with the quarterly review. Revenue is up 15 percent compared to last quarter. Our customer satisfaction scores have improved to 4.6 out of 5. The main challenge remains scaling our infrastructure to meet demand.",
        22,
        [(0.0, 3.5, "Good morning everyone."), (3.5, 7.2, "Let's start with the quarterly review."), (7.2, 12.8, "Revenue is up 15 percent compared to last quarter."), (12.8, 17.1, "Our customer satisfaction scores have improved to 4.6 out of 5."), (17.1, 22.0, "The main challenge remains scaling our infrastructure to meet demand.")],
    ),
    "lecture": (
        "Today we'll discuss neural network architectures. Transformers have become the dominant architecture for natural language processing. The key innovation is the self-attention mechanism, which allows the model to weigh the importance of different parts of the input.",
        18,
        [(0.0, 4.0, "Today we'll discuss neural network architectures."), (4.0, 10.5, "Transformers have become the dominant architecture for natural language processing."), (10.5, 18.0, "The key innovation is the self-attention mechanism, which allows the model to weigh the importance of different parts of the input.")],
    ),
    "voicemail": (
        "Hi, this is Sarah from the marketing team. I wanted to follow up on the campaign proposal we discussed on Tuesday. Could you send me the updated budget numbers by end of day Friday? Thanks, talk to you soon.",
        14,
        [(0.0, 3.8, "Hi, this is Sarah from the marketing team."), (3.8, 8.5, "I wanted to follow up on the campaign proposal we discussed on Tuesday."), (8.5, 12.5, "Could you send me the updated budget numbers by end of day Friday?"), (12.5, 14.0, "Thanks, talk to you soon.")],
    ),
}
OTHER_TRANSCRIPT = [  # Fixed values, for any other source
    (0.0, 15.0, "This is a transcription of the provided audio."),
    (15.0, 30.0, "The speaker discusses various topics including project updates, timeline adjustments, and next steps for the team."),
]
MIME_TYPES = {".json": "application/json", ".csv": "text/csv", ".txt": "text/plain", ".md": "text/markdown", ".xml": "application/xml", ".html": "text/html"}
