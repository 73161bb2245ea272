"""Rule values used by the jobs.

Everything here is a default: each job takes its rule table as an argument, and
``sources.rulesets.load_rules`` reads a full rule set from JSON.
"""

# --- Fixed values: these must equal the published behaviour for right results. ---

UNKNOWN_NAME = "未知频道"
OTHER_CATEGORY = "其他频道"
CCTV_CATEGORY = "央视频道"
SATELLITE_CATEGORY = "卫视频道"

CATEGORY_ORDER = [
    "4K专区", "港澳台频", "影视剧集", "央视频道", "卫视频道",
    "体育赛事", "少儿动漫", "新闻资讯", "音乐频道", "其他频道",
]

CATEGORY_LABELS = {
    "4K专区": "4K", "港澳台频": "GDHKTW", "影视剧集": "Movies", "央视频道": "CCTV",
    "卫视频道": "Variety", "体育赛事": "Sports", "少儿动漫": "Kids",
    "新闻资讯": "News", "音乐频道": "Music", "其他频道": "Other",
}

BLACKLIST = [
    "购物", "备用", "测试", "福利", "广告", "下线", "加群", "提示", "教程", "联系",
    "推广", "免费", "无效", "过期", "失效", "禁播", "视频", "点播", "直播带货", "广告推广",
]

OVERSEAS_KEYWORDS = [
    "TVB", "凤凰", "翡翠", "明珠", "香港", "台湾", "台视", "华视", "民视", "东森",
    "三立", "纬来", "中天", "非凡", "龙祥", "靖天", "爱尔达", "CNN", "BBC", "NHK",
    "KBS", "SBS", "MBC", "DISCOVERY", "国家地理", "HBO", "STAR", "AXN", "KIX",
    "VIU", "NOW", "FOX", "ESPN", "BEIN", "HOY", "ViuTV", "澳广视", "TDM", "壹电视",
    "TVBS", "八大", "博斯", "澳", "公视", "华文", "八度", "华艺", "Z频道", "GOOD",
    "星空", "寰宇", "GEM", "J2", "开电视", "奇妙电视", "有线宽频", "Now TV",
    "Cable TV", "PCCW", "HKTV", "TTV", "FTV", "TRANSTV", "Fuji TV", "WOWOW",
    "Sky", "DAZN", "Eleven Sports", "SPOTV NOW",
]

VOD_HOSTS = [
    "vd2.bdstatic.com", "vd3.bdstatic.com", "vd4.bdstatic.com", "vd1.bdstatic.com",
    "m.v.qq.com", "m.iqiyi.com", "m.youku.com", "m.bilibili.com", "m.mgtv.com", "m.pptv.com",
    "m.le.com", "m.wasu.cn", "m.1905.com", "m.fun.tv", "m.baomihua.com", "m.pearvideo.com",
    "m.56.com", "m.ku6.com", "m.tudou.com", "m.letv.com", "m.sohu.com", "m.sina.com.cn",
    "m.ifeng.com", "m.people.com.cn", "m.xinhuanet.com", "m.cctv.com", "m.chinanews.com",
    "m.huanqiu.com", "m.globaltimes.cn", "m.youth.cn", "m.gmw.cn", "m.ce.cn",
    "m.caijing.com.cn", "m.hexun.com", "m.jrj.com", "m.stockstar.com", "m.10jqka.com.cn",
    "m.eastmoney.com", "m.163.com", "m.qq.com", "m.toutiao.com", "m.baidu.com", "m.weibo.com",
    "m.douyin.com", "m.kuaishou.com", "m.xiaohongshu.com", "m.acfun.cn", "m.nicovideo.jp",
    "m.youtube.com", "m.vimeo.com", "m.dailymotion.com", "m.twitch.tv", "m.tiktok.com",
    "m.instagram.com", "m.twitter.com", "m.facebook.com", "qingting.fm", "kwimgs.com",
    "kuaishou.com", "douyin.com", "ixigua.com", "huoshan.com", "pipix.com",
    "xinpianchang.com", "vmovier.com", "miaopai.com", "weishi.com", "yixia.com",
    "meipai.com", "xiaokaxiu.com", "quanmin.tv", "yy.com", "huya.com", "douyu.com",
    "egame.qq.com", "live.qq.com", "inke.cn", "huajiao.com", "yizhibo.com", "taobao.com",
    "tmall.com", "jd.com", "pinduoduo.com", "suning.com", "vip.com", "dangdang.com",
    "amazon.cn", "ximalaya.com", "lizhi.fm", "dragonfm.com", "radio.cn", "music.163.com",
    "y.qq.com", "kugou.com", "kuwo.cn", "xiami.com", "tme.qq.com", "joox.com",
    "spotify.com", "goodiptv.club/douyu", "goodiptv.club/huya", "goodiptv.club/bilibili",
]

ALLOW_DOMAINS = ["github.com", "githubusercontent.com", "gitlab.com", "gitee.com"]
DENY_DOMAINS = ["shortlink", "bit.ly", "tinyurl", "adf.ly", "link-short", "goo.gl"]
OBJECT_STORE_MARKS = [".oss-", ".cos.", ".s3.", "cosv", ".obj"]
CDN_MARKS = ["cfcdn", "jsdelivr", "cdnjs", "unpkg", "fastly"]

DIRECT_KEYS = [
    "live.264788", "goodiptv", "163189", "jdshipin", "tencentplay", "bp-resource", "bestv",
    "amucn", "xryo", "migu", "dsj", "ottiptv", "iill", "aktv", "ott.mobai", "mobai",
    "cdn8.", "cdn6.", "cdn12.", "cdn.", "cos.", "tencent.", "aliyun", "alicdn", "ali-cdn",
    "aliyuncs", "qcloud", "myqcloud", "tencentyun", "speedws", "bdstatic", "bcebos",
    "chinamobile", "unicom", "chinanet", "telecom", "otttv", "bj.chinamobile",
    "sn.chinamobile", "dbiptv", "yinhe", "hwltm", "zteres", "jsdelivr", "bootcdn", "staticfile",
]
DIRECT_IPV6_PREFIXES = ["2409:8087", "2408:8000", "240e:600", "240e:900"]
CARRIER_IPV6_MARKS = ["[2409:8087", "[2408:8000", "[240e:"]

CREDENTIAL_PARAMS = [
    "userid=", "sign=", "auth_token=", "token=", "session=", "expire=", "key=", "nonce=",
]
REJECTED_EXTENSIONS = [
    "js", "css", "jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "woff", "woff2", "ttf",
    "eot", "mp4", "mp3", "avi", "mkv", "zip", "rar", "tar", "gz", "pdf", "doc", "docx",
    "xls", "xlsx", "json", "xml", "yml", "yaml", "md",
]
PLAYLIST_ROUTES = ["/live/", "/tv/", "/stream/", "/playlist/", "/iptv/", "/channels/", "/feed"]
PLAYLIST_TYPE_PARAMS = ["php?type=m3u", "/playlist?", "?type=m3u"]
LEGACY_CREDENTIAL_PARAMS = ["userid=", "sign=", "auth_token=", "token=", "session="]
LEGACY_PLAYLIST_MARKS = [".m3u", ".m3u8", ".txt", "php?type=m3u", "/playlist", "?type=m3u"]

# Link patterns searched in free text, case-insensitive.
URL_PATTERNS = [
    r"https?://[^\s<>\"']+\.(?:m3u|m3u8|txt)(?:\?[^\s<>\"']*)?",
    r"https?://[^\s<>\"']+(?:/live|/stream|/tv|/playlist|/iptv|/m3u|/channels?|/feed)(?:[^\s<>\"']*)?",
    r"https?://[^\s<>\"']+:\d{4,5}(?:/[^\s<>\"']*)?",
    r"https?://[^\s<>\"']+\.(?:php|xml)(?:\?[^\s<>\"']*)?",
    r"https?://[^\s<>\"']+(?:\.cos\.[^\s<>\"']+|\.oss\.[^\s<>\"']+|\.s3[^\s<>\"']+)(?:/[^\s<>\"']*)?",
]

LEGACY_URL_PATTERNS = [
    r"https?://[^\s<>\"']+\.(?:m3u|m3u8|txt|php\?|\?type=m3u)[^\s<>\"']*",
    r"https?://[^\s<>\"']+/live[^\s<>\"']*",
    r"https?://[^\s<>\"']+/stream[^\s<>\"']*",
    r"https?://[^\s<>\"']+/tv[^\s<>\"']*",
    r"https?://[^\s<>\"']+:\d{4,5}[^\s<>\"']*",
]

# Files on code hosting, and where else they may be fetched.
HOSTED_RAW = r"^https://raw\.githubusercontent\.com/([^/]+)/([^/]+)/([^/]+)/(.+)"
HOSTED_PAGE = r"^https://github\.com/([^/]+)/([^/]+)/(?:raw|blob)/([^/]+)/(.+)"
HOSTED_ORIGIN = "https://raw.githubusercontent.com/$1/$2/$3/$4"
MIRRORS = [
    "https://testingcf.jsdelivr.net/gh/$1/$2@$3/$4",
    "https://mirror.ghproxy.com/{origin}",
    "https://gh-proxy.com/{origin}",
]

# Ends of the links that the earlier crawl opened.
LEGACY_OPENED = [".m3u", ".m3u8", ".txt"]

ANTIBOT_MARKS = [
    "<!doctype", "<html", '{"code"', "<script", "cloudfront", "accessdenied", "rate limit",
]
LEGACY_ANTIBOT_MARKS = ["<!doctype html", "<html", '{"code"']
UNSAFE_LINK_MARKS = ["javascript:", "data:", "about:", "void("]

FATAL_PHRASES = [
    "404 not found", "403 forbidden", "500 internal server error", "connection timed out",
    "could not resolve host", "connection refused", "no route to host", "network unreachable",
    "name or service not known", "unable to open file", "invalid url", "protocol not found",
    "server returned 404", "server returned 403", "server returned 500", "host unreachable",
    "dns resolution failed", "empty reply from server", "405 method not allowed",
    "forbidden", "not found",
]
STREAM_MARKS = ["codec_type=video", "codec_type=audio"]

LIVE_NAME_PATTERN = (
    "频道|台|卫视|影院|剧场|电影|剧集|直播|体育|音乐|新闻|综合|少儿|动漫|教育|财经|"
    "Discovery|Channel|TV|News|Live|Sport|Music|Kids|Movie|Film|Drama|Anime"
)

SENSITIVE_PARAMS = [
    "userid", "sign", "auth_token", "token", "key", "secret", "password", "passwd", "tk",
    "auth", "verify", "access_token", "refresh_token", "expires_in", "nonce", "authkey",
    "encrypt", "client_secret", "migutoken", "msisdn", "txsecret", "txtime", "signkey",
    "api_key", "apikey", "private_key", "pwd", "authcode", "sid", "spid", "clientid",
    "client_id", "deviceid", "device_id", "session", "sessionid", "signstr", "sign_type",
    "resign", "authkey2", "auth_token_v2", "sign_token", "secure_token", "access_key",
    "accesskey", "access_secret", "authsign", "checksum", "hash", "md5", "sha",
]
FINGERPRINT_KEEP_PARAMS = ["id", "token", "key", "sign", "auth", "code", "streamid"]

# Name noise, removed in this order, case-insensitive and Unicode-aware.
NAME_NOISE = [
    r"[\(\[\{【＜『「『（][^\)\]\}】＞』」』）]*[\)\]\}】＞』」』）]?",
    r"\b(1080[PI]?|720[PI]?|480[PI]?|360[PI]?|4K|8K|UHD|HDR|SD|HD|FHD)\b",
    r"\d{3,5}[Kk][Bb]?[Pp]?[Ss]?",
    r"(源|线路|节点|备|主|副|HD|SD|高清|标清|超清|蓝光|原画|流畅)[123]?",
    r"(在线|离线|测试|正式|备用|主用)",
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}:\d{2}",
    r"[★☆●○◆◇■□▲△▶▼◀♢♤♧♡♢♠♣♥♦]",
]
CCTV_TYPE_SUFFIXES = [
    "综合", "财经", "综艺", "中文国际", "体育", "电影", "国防军事", "电视剧", "纪录", "科教",
    "戏曲", "社会与法", "新闻", "少儿", "音乐", "奥林匹克", "农业农村", "体育赛事",
]
QUALITY_SUFFIXES = ["高清", "超清", "蓝光", "4K", "8K", "HD", "FHD", "UHD", "标清"]

# Display labels of numbered channels: (number, word looked for in the raw name, label).
CCTV_LABELS = [
    (1, "综合", "综合"), (2, "财经", "财经"), (3, "综艺", "综艺"), (4, "中文国际", "中文国际"),
    (5, "体育", "体育"), (6, "电影", "电影"), (7, "国防军事", "国防军事"), (8, "电视剧", "电视剧"),
    (9, "纪录", "纪录"), (10, "科教", "科教"), (11, "戏曲", "戏曲"), (12, "社会与法", "社会与法"),
    (13, "新闻", "新闻"), (14, "少儿", "少儿"), (15, "音乐", "音乐"), (16, "奥运", "奥林匹克"),
    (17, "农业", "农业农村"),
]

LEGACY_OVERSEAS_PREFIXES = [
    "TVB", "TVBS", "BS", "CH", "FOX", "ESPN", "HBO", "ViuTV", "NOW", "ASTRO", "WOWOW", "NHK",
    "博斯", "凤凰", "翡翠", "明珠", "HOY", "澳广视", "TDM",
]
LEGACY_EMOJI = (
    r"[\x{10000}-\x{10ffff}\x{2600}-\x{27ff}\x{f600}-\x{f6ff}\x{f300}-\x{f3ff}\x{2300}-\x{23ff}"
    r"\x{2500}-\x{25ff}\x{2100}-\x{21ff}\x{a9}\x{ae}\x{2000}-\x{206f}\x{2460}-\x{24ff}"
    r"\x{1f00}-\x{1fff}]+"
)
LEGACY_NOISE = (
    r"(?:\(.*?\))|(?:\[.*?\])|(?:【.*?】)|(?:《.*?》)|(?:<.*?>)|(?:\{.*\})|(?:（.*?）)"
)
LEGACY_HIRES = r"4K|8K|UHD|ULTRAHD|2160|HDR|超高清|杜比视界"
LEGACY_CCTV = r"((?:CCTV|ＣＣＴＶ)\s*[-—_～•·:\s]*\d{1,2}\+?)"
LEGACY_SUFFIX = (
    r"(?:[-_—～•·:\s|/\\]+|HD|1080p|720p|360p|540p|高清|超清|超高清|标清|主线|备用\d*|线路\d*)$"
)
LEGACY_BLANK = r"^[\s\-—_～•·:·]+$"

# Aliases in match order; the first contained alias wins.
ALIASES = [
    ("CCTV1", "CCTV-1"), ("CCTV2", "CCTV-2"), ("CCTV3", "CCTV-3"), ("CCTV4", "CCTV-4"),
    ("CCTV5", "CCTV-5"), ("CCTV6", "CCTV-6"), ("CCTV7", "CCTV-7"), ("CCTV8", "CCTV-8"),
    ("CCTV9", "CCTV-9"), ("CCTV10", "CCTV-10"), ("CCTV11", "CCTV-11"), ("CCTV12", "CCTV-12"),
    ("CCTV13", "CCTV-13"), ("CCTV14", "CCTV-14"), ("CCTV15", "CCTV-15"), ("CCTV16", "CCTV-16"),
    ("CCTV17", "CCTV-17"), ("CCTV5PLUS", "CCTV-5+"), ("CCTV5+", "CCTV-5+"),
    ("中央一台", "CCTV-1"), ("中央二台", "CCTV-2"), ("中央三台", "CCTV-3"),
    ("中央四台", "CCTV-4"), ("中央五台", "CCTV-5"), ("中央六台", "CCTV-6"),
    ("中央七台", "CCTV-7"), ("中央八台", "CCTV-8"), ("中央1台", "CCTV-1"),
    ("中央2台", "CCTV-2"), ("中央3台", "CCTV-3"), ("中央4台", "CCTV-4"), ("中央5台", "CCTV-5"),
    ("中央6台", "CCTV-6"), ("中央7台", "CCTV-7"), ("中央8台", "CCTV-8"), ("央视一套", "CCTV-1"),
    ("央视二套", "CCTV-2"), ("央视三套", "CCTV-3"), ("央视四套", "CCTV-4"),
    ("央视五套", "CCTV-5"), ("央视六套", "CCTV-6"), ("央视七套", "CCTV-7"),
    ("央视八套", "CCTV-8"), ("央视1套", "CCTV-1"), ("央视2套", "CCTV-2"), ("央视3套", "CCTV-3"),
    ("央视4套", "CCTV-4"), ("央视5套", "CCTV-5"), ("央视6套", "CCTV-6"), ("央视7套", "CCTV-7"),
    ("央视8套", "CCTV-8"), ("综合频道", "CCTV-1"), ("经济频道", "CCTV-2"),
    ("综艺频道", "CCTV-3"), ("中文国际", "CCTV-4"), ("体育频道", "CCTV-5"),
    ("电影频道", "CCTV-6"), ("国防军事", "CCTV-7"), ("电视剧频道", "CCTV-8"),
    ("纪录频道", "CCTV-9"), ("科教频道", "CCTV-10"), ("戏曲频道", "CCTV-11"),
    ("社会与法", "CCTV-12"), ("新闻频道", "CCTV-13"), ("少儿频道", "CCTV-14"),
    ("音乐频道", "CCTV-15"), ("奥林匹克", "CCTV-16"), ("农业农村", "CCTV-17"),
    ("中央九台", "CCTV-9"), ("中央十台", "CCTV-10"), ("中央十一台", "CCTV-11"),
    ("中央十二台", "CCTV-12"), ("中央十三台", "CCTV-13"), ("中央十四台", "CCTV-14"),
    ("中央十五台", "CCTV-15"), ("中央十六台", "CCTV-16"), ("中央十七台", "CCTV-17"),
    ("中央9台", "CCTV-9"), ("中央10台", "CCTV-10"), ("中央11台", "CCTV-11"),
    ("中央12台", "CCTV-12"), ("中央13台", "CCTV-13"), ("中央14台", "CCTV-14"),
    ("中央15台", "CCTV-15"), ("中央16台", "CCTV-16"), ("中央17台", "CCTV-17"),
    ("湖南电视台", "湖南卫视"), ("浙江电视台", "浙江卫视"), ("江苏电视台", "江苏卫视"),
    ("东方电视台", "东方卫视"), ("北京电视台", "北京卫视"), ("广东电视台", "广东卫视"),
    ("山东电视台", "山东卫视"), ("四川电视台", "四川卫视"), ("安徽电视台", "安徽卫视"),
    ("天津电视台", "天津卫视"), ("河北电视台", "河北卫视"), ("河南电视台", "河南卫视"),
    ("湖北电视台", "湖北卫视"), ("江西电视台", "江西卫视"), ("重庆电视台", "重庆卫视"),
    ("福建电视台", "福建卫视"), ("辽宁电视台", "辽宁卫视"), ("深圳电视台", "深圳卫视"),
    ("广西电视台", "广西卫视"), ("黑龙江电视台", "黑龙江卫视"), ("云南电视台", "云南卫视"),
    ("陕西电视台", "陕西卫视"), ("甘肃电视台", "甘肃卫视"), ("贵州电视台", "贵州卫视"),
    ("山西电视台", "山西卫视"), ("吉林电视台", "吉林卫视"), ("内蒙古电视台", "内蒙古卫视"),
    ("宁夏电视台", "宁夏卫视"), ("新疆电视台", "新疆卫视"), ("海南电视台", "海南卫视"),
    ("青海电视台", "青海卫视"), ("西藏电视台", "西藏卫视"), ("上海卫视", "东方卫视"),
    ("翡翠台", "翡翠"), ("明珠台", "明珠"), ("TVB翡翠", "翡翠"), ("凤凰卫视中文", "凤凰中文"),
    ("凤凰卫视资讯", "凤凰资讯"), ("凤凰卫视", "凤凰"), ("凤凰", "凤凰"), ("TVBS", "TVBS新闻"),
    ("东森新闻", "东森新闻"),
]

# Address blocks that are not globally reachable (IANA special-purpose registries),
# and the globally reachable blocks inside them.
NON_PUBLIC_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
    "::1/128", "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4",
    "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3",
    "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9",
    "fe80::/10",
]
PUBLIC_EXCEPTIONS = [
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32",
    "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]

# --- Small defaults of our own; pass a full table for production use. ---

CATEGORY_RULES = {
    "4K专区": ["4K", "8K", "UHD", "2160", "超高清", "HDR"],
    "港澳台频": ["TVB", "翡翠", "明珠", "凤凰", "东森", "中天", "香港", "台湾", "澳门", "BBC", "CNN", "NHK", "NOW", "HBO"],
    "影视剧集": ["电影", "影院", "影视", "剧场", "电视剧", "短剧"],
    "央视频道": ["CCTV", "中央", "央视", "CETV"],
    "卫视频道": ["卫视", "湖南", "浙江", "江苏", "东方", "北京", "广东"],
    "体育赛事": ["体育", "足球", "篮球", "SPORT", "NBA", "高尔夫"],
    "少儿动漫": ["卡通", "动漫", "动画", "少儿", "KIDS", "CARTOON"],
    "新闻资讯": ["新闻", "资讯", "财经", "NEWS"],
    "音乐频道": ["音乐", "MTV", "演唱会", "KTV"],
}

# Traditional to simplified, single characters only (no phrase rules).
TRADITIONAL = "鳳凰衛視廣東電臺體育頻綜聞財經藝國際紀錄軍農業學劇場戲樂壹華龍亞門灣陽號線備測試購聯繫緯來開緊東台無寶漢語現馬賽網動畫兒連續"
SIMPLIFIED = "凤凰卫视广东电台体育频综闻财经艺国际纪录军农业学剧场戏乐壹华龙亚门湾阳号线备测试购联系纬来开紧东台无宝汉语现马赛网动画儿连续"
