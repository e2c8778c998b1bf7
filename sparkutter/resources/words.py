"""Word lists for Indonesian speech: fillers, editing terms, reduplicated words, function words."""

# Results depend on exactly these words, patterns and thresholds.
FILLED_PAUSES = (
    "e", "ee", "eee", "em", "emm", "hm", "hmm", "mm", "mmm", "mmh", "ehm", "ehem", "heem", "hem", "aa", "aaa", "oo", "ooo", "uh", "uhm",
    "um", "er", "err", "ng", "nggg", "anu",
)
AMBIGUOUS_PAUSES = (
    "eh", "ah", "oh", "ih", "aduh", "wah",
)
DISCOURSE_MARKERS = (
    "jadi", "jadinya", "nah", "terus", "trus", "kayak", "kaya", "kayaknya", "gitu", "gini", "ya", "yah", "iya", "kan", "sih", "deh", "dong",
    "tuh", "nih", "lah", "pokoknya", "istilahnya", "ibaratnya", "semacam", "semacem", "gimana", "apa", "sebenarnya", "sebenernya",
    "sebetulnya", "mungkin", "mungkin ya", "oke", "okay", "gitu deh", "ya udah",
)
DISCOURSE_PHRASES = (
    "apa ya", "apa sih", "apa tuh", "apa namanya", "apa istilahnya", "gimana ya", "gimana sih", "gimana bilangnya", "itu loh", "itu lho",
    "gitu loh", "gitu lho", "gitu ya", "gitu kan", "gini loh", "gini lho", "ya kan", "iya kan", "kayak gitu", "kayak gini",
    "apa ya namanya", "gimana ya ngomongnya", "ya pokoknya", "jadi gitu", "nah itu", "kurang lebih",
)
EDITING_TERMS = (
    "eh", "maaf", "sori", "sorry", "ralat", "maksudnya", "maksud saya", "bukan",
)
STRONG_EDITING_TERMS = (
    "eh", "maaf", "sori", "sorry", "ralat", "maksudnya",
)
INHERENT_REDUPLICATIONS = (
    "kupu-kupu", "laba-laba", "kura-kura", "ubur-ubur", "lumba-lumba", "cumi-cumi", "biri-biri", "layang-layang", "paru-paru",
    "empek-empek", "teka-teki", "undang-undang", "gara-gara", "pura-pura", "sia-sia", "alun-alun", "kupu-kupu", "onde-onde", "otak-otak",
    "kunang-kunang", "anai-anai", "ubun-ubun", "labi-labi", "rama-rama",
)
RHYMING_REDUPLICATIONS = (
    "sayur-mayur", "ramah-tamah", "gerak-gerik", "warna-warni", "mondar-mandir", "bolak-balik", "compang-camping", "kacau-balau",
    "huru-hara", "simpang-siur", "tunggang-langgang", "lauk-pauk", "serba-serbi", "desas-desus", "corat-coret", "porak-poranda",
    "gotong-royong", "tolong-menolong", "tindih-menindih",
)
LEXICAL_REDUPLICATIONS = (
    "anak-anak", "orang-orang", "teman-teman", "kawan-kawan", "buku-buku", "barang-barang", "hal-hal", "jenis-jenis", "macam-macam",
    "bagian-bagian", "pihak-pihak", "kata-kata", "tempat-tempat", "hari-hari", "kota-kota", "negara-negara", "ide-ide", "data-data",
    "sekolah-sekolah", "rumah-rumah", "murid-murid", "guru-guru", "bapak-bapak", "ibu-ibu", "adik-adik", "kakak-kakak", "saudara-saudara",
    "tetangga-tetangga", "tiba-tiba", "kadang-kadang", "buru-buru", "hati-hati", "diam-diam", "pelan-pelan", "cepat-cepat", "lama-lama",
    "baik-baik", "sedikit-sedikit", "sungguh-sungguh", "benar-benar", "betul-betul", "malu-malu", "tanda-tanda", "seolah-olah",
    "akhir-akhir", "baru-baru", "mula-mula", "terus-menerus", "jalan-jalan", "main-main", "coba-coba", "lihat-lihat", "cari-cari",
    "tanya-tanya", "iseng-iseng", "santai-santai", "pagi-pagi", "malam-malam", "siang-siang", "subuh-subuh", "sore-sore", "jauh-jauh",
    "susah-susah", "capek-capek", "masing-masing", "tiap-tiap", "satu-satu", "dua-dua", "sama-sama", "kira-kira", "sekali-kali",
    "sewaktu-waktu", "sesekali", "berbondong-bondong", "berlari-lari", "berjalan-jalan", "bermain-main", "berputar-putar",
    "bergoyang-goyang", "tarik-menarik", "kejar-kejaran", "pukul-memukul", "surat-menyurat", "kupu-kupuan", "mobil-mobilan",
    "rumah-rumahan", "kuda-kudaan",
)
FUNCTION_WORDS = (
    "saya", "aku", "gue", "gua", "kamu", "kau", "lu", "lo", "anda", "dia", "ia", "beliau", "kita", "kami", "mereka", "nya", "yang", "di",
    "ke", "dari", "pada", "kepada", "untuk", "buat", "dengan", "sama", "oleh", "dalam", "atas", "bawah", "antara", "dan", "atau", "tetapi",
    "tapi", "namun", "melainkan", "serta", "karena", "sebab", "kalau", "jika", "bila", "apabila", "bahwa", "adalah", "ialah", "yaitu",
    "yakni", "itu", "ini", "situ", "sini", "sana", "akan", "sudah", "telah", "sedang", "lagi", "masih", "belum", "tidak", "nggak", "ngga",
    "gak", "enggak", "bukan", "jangan", "harus", "mesti", "bisa", "dapat", "boleh", "mau", "ingin", "juga", "saja", "aja", "hanya", "cuma",
    "pun", "per", "ada", "para", "sang", "si", "terhadap", "sebagai", "tentang", "mengenai", "hingga", "sampai", "agar", "supaya",
    "sehingga", "ketika", "saat", "waktu", "setelah", "sebelum", "selama", "sejak", "walaupun", "meskipun", "meski", "kendati", "maka",
    "lalu",
)
FUNCTION_REDUPLICATIONS = (
    "masing-masing", "tiap-tiap", "satu-satu", "sama-sama", "kira-kira", "mula-mula", "sekali-kali", "sewaktu-waktu", "kadang-kadang",
    "lama-lama", "akhir-akhir", "baru-baru", "diam-diam", "tiba-tiba",
)
AFFIX_PATTERNS = (
    r"^ber([a-z]+)-\1$",
    r"^ter([a-z]+)-\1$",
    r"^([a-z]+)-me[nmngy]?\1$",
    r"^([a-z]+)-\1an$",
    r"^se([a-z]+)-\1nya$",
    r"^ke([a-z]+)-\1an$",
)
GAP_REDUPLICATION_MOST = 0.08  # seconds
GAP_DISFLUENCY_LEAST = 0.18
OPENERS = ("jadi", "jadinya", "terus", "trus", "sebenarnya", "sebenernya", "sebetulnya")
ANSWERS = ("ya", "yah", "iya", "apa", "gimana")
DEMONSTRATIVES = ("gitu", "gini")
DEMONSTRATIVE_TAILS = ("saja", "aja", "juga", "doang")
