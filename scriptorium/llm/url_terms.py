"""The vocabulary of the url filter: words of unwanted sites in several languages, of two weights."""

#: One of these rejects a url. Fixed values of this project.
STRICT_TERMS = (
    "anal", "bdsm", "blowjob", "bordell", "bordello", "camgirl", "camgirls", "casino", "cialis", "cumshot", "dildo",
    "ecchi", "ero", "erotic", "erotica", "erotik", "erotika", "erotique", "escort", "escorts", "fetish", "fetisch", "gangbang",
    "hardcore", "hentai", "hooker", "hookup", "huren", "kamagra", "levitra", "milf", "naked", "nackt", "nude", "nudes", "nudist",
    "onlyfans", "orgy", "pills", "porn", "porno", "pornos", "pornografia", "pornographie", "pornstar", "prostituees", "putas",
    "sex", "sexcam", "sexo", "sexe", "sexshop", "sexy", "slots", "spielbank", "striptease", "swinger", "tits", "tramadol",
    "viagra", "webcamsex", "xanax", "xnxx", "xvideos", "xxx", "warez", "keygen", "cracked", "darknet",
)
#: Several distinct ones of these reject a url. Fixed values of this project.
SOFT_TERMS = (
    "adult", "adulte", "adultos", "affiliate", "angebot", "apuesta", "apuestas", "bet", "bets", "betting", "billig", "bingo",
    "bitcoin", "bonus", "buy", "cams", "cash", "cheap", "clickbait", "coupon", "coupons", "credit", "crypto", "dating", "deal",
    "deals", "discount", "download", "encuentros", "flirt", "forex", "free", "gambling", "geld", "gewinn", "gewinnspiel", "gratis",
    "gratuit", "hot", "jackpot", "kaufen", "kostenlos", "kredit", "loan", "loans", "loterie", "loteria", "lottery", "lotto",
    "meds", "meilleur", "mp3", "nulled", "oferta", "offer", "offers", "payday", "pharmacy", "poker", "premio", "prestamo",
    "pret", "prize", "prizes", "promo", "promocode", "rabatt", "rencontre", "replica", "roulette", "sale", "seo", "singles",
    "spiele", "torrent", "torrents", "traffic", "viral", "voyance", "wetten", "win", "winner", "winners",
)
