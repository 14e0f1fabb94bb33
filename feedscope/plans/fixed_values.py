"""Word lists, scores and site facts that decide results.

Everything in this module is data that must hold exactly these values for the
answers to be right.  It is stated plainly and in its natural order; no logic
lives here.  Every list can be replaced by a caller (see ``rules.RulePack``).
"""

# --- fixed values: one row per source -------------------------------------
# site_id | name | library | group | authority | home region | class | category
# class: green/ai/robot pass as a whole, tech/ai_media/social need a word hit,
#        keyword goes through the title test.
SITES = """
ndrc|国家发改委|policy|中国|25|中国|green|gov
mee|生态环境部|policy|中国|25|中国|green|gov
mee_jiedu|生态环境部·解读|policy|中国|23|中国|keyword|gov
nea|国家能源局|policy|中国|25|中国|green|gov
miit|工信部|policy|中国|25|中国|green|gov
us_epa|美国EPA|policy|美国|25|美国|green|gov
us_doe|美国DOE|policy|美国|25|美国|green|gov
eu_commission|欧盟委员会|policy|欧盟|25|欧盟|green|gov
euractiv|Euractiv·欧盟|media||20|欧盟|keyword|media
india_pib|印度PIB|policy|印度|25|印度|green|gov
us_noaa|美国NOAA|policy|美国|25|美国|green|gov
us_eia|美国EIA|policy|美国|25|美国|green|gov
us_ferc|美国FERC|policy|美国|25|美国|green|gov
us_carb|加州CARB|policy|美国|25|美国|green|gov
jp_moe|日本环境省|policy|日本|25|日本|green|gov
jp_meti|日本经产省|policy|日本|25|日本|green|gov
jp_anre|日本资源能源厅|policy|日本|25|日本|green|gov
e3g|E3G|media||18|欧盟|green|kol
agora|Agora·能源转型|media||18|欧盟|green|kol
teri|TERI·印度能源与资源所|media||18|印度|green|kol
brookings|Brookings|media||18|美国|keyword|kol
bruegel|Bruegel|media||18|欧盟|keyword|kol
piie|PIIE|media||18|美国|keyword|kol
csis|CSIS|media||18|美国|keyword|kol
chatham|Chatham House|media||18|欧盟|keyword|kol
carnegie|Carnegie|media||18|美国|keyword|kol
rand|RAND|media||18|美国|keyword|kol
americanprogress|CAP|media||18|美国|keyword|kol
goldman|高盛Insights|media||18|美国|keyword|kol
caixin|财新|media||18|中国|keyword|media
chinanecc|国家节能中心|policy|中国|22|中国|green|gov
thepaper|澎湃新闻|media||16|中国|keyword|media
artificialanalysis|Artificial Analysis|media||16|国际|ai|kol
36kr|36氪|media||13|中国|ai_media|media
huxiu|虎嗅|media||13|中国|ai_media|media
pbc|中国人民银行|policy|中国|25|中国|green|gov
cneeex|上海环交所|policy|中国|25|中国|green|gov
ncsc|NCSC国家气候中心|policy|中国|25|中国|green|gov
caep|环境规划院CAEP|policy|中国|25|中国|green|gov
cenews|中国环境报|media|中国|16|中国|keyword|media
cnesa|CNESA储能联盟|media|中国|16|中国|keyword|media
ccai|Climate Change AI|media||18|国际|ai|kol
stdaily|中国科技网|media||16|中国|green|media
iea|IEA|policy|国际组织|22|国际|green|intl
irena|IRENA|policy|国际组织|22|国际|green|intl
carbonbrief|Carbon Brief|media||18|国际|green|media
unfccc|UNFCCC|policy|国际组织|22|国际|green|intl
worldbank|World Bank Climate|policy|国际组织|22|国际|green|intl
reuters|Reuters Energy|media||13|全球|green|media
bjx|北极星电力网|media||13|中国|green|media
tanpaifang|中国碳交易网|media||18|中国|green|media
ideacarbon|碳道|media||18|中国|green|media
chinaenergy|中国能源报|media||13|中国|green|media
cleantechnica|CleanTechnica|media||16|国际|keyword|media
jiqizhixin|机器之心|media||18|中国|ai|kol
qbitai|量子位|media||18|中国|ai|kol
openai|OpenAI|media||20|国际|ai|kol
venturebeat|VentureBeat AI|media||16|国际|ai|kol
arxiv_ai|arXiv cs.AI|media||18|国际|ai|kol
aihot|AIHOT|media||18|中国|ai|kol
radarai|RadarAI·GitHub趋势|media||12|国际|tech|hot
therobotreport|The Robot Report|media||16|全球|robot|media
spectrum|IEEE Spectrum|media||16|全球|robot|media
qianjia|千家网|media||13|中国|keyword|media
greenbuilder|Green Builder Media|media||16|美国|keyword|media
cheaa|中国家电网|media||13|中国|keyword|media
greenpeace|绿色和平|media||18|中国|green|media
mongabay|Mongabay|media||18|全球|green|media
allnet|全网热点|media||8|中国|keyword|hot
x|X平台|media||16|全球|social|kol
"""
SITES_WEEKLY = ["us_epa", "us_doe", "us_noaa", "us_eia", "us_ferc", "us_carb", "eu_commission",
                "euractiv", "india_pib", "jp_moe", "jp_meti", "jp_anre", "ncsc", "caep"]
SITES_SLOW = ["e3g", "agora", "teri", "greenpeace", "brookings", "bruegel", "piie", "csis",
              "chatham", "carnegie", "rand", "americanprogress", "goldman", "chinanecc"]
WINDOW_HOURS = {"default": 96, "weekly": 168, "slow": 504}
DEFAULT_AUTHORITY = 10
DEFAULT_LAYOUT = ("policy", "其他")
DEFAULT_REGION = "国际"
DEFAULT_CATEGORY = "other"
CATEGORY_ORDER = ["gov", "intl", "media", "kol", "hot", "other"]
RETENTION_DAYS = 62
HEALTH_SNAPSHOTS = 192
STREAK_SNAPSHOTS = 96

# --- fixed values: relevance words -----------------------------------------
RELEVANCE = [
    "碳", "绿色", "低碳", "减排", "双碳", "新能源", "可再生能源", "节能", "环保", "气候",
    "碳中和", "碳达峰", "清洁能源", "光伏", "风电", "储能", "氢能", "核能", "生物质",
    "碳交易", "碳市场", "碳关税", "碳足迹", "碳普惠", "ESG", "可持续发展", "循环经济",
    "绿色制造", "绿色金融", "能源转型", "电力市场", "新型电力系统", "生态环境", "污染防治",
    "蓝天保卫战", "以旧换新", "CCUS", "碳捕集", "发改", "能源", "电力", "成品油", "天然气",
    "煤炭", "carbon", "climate", "green", "renewable", "clean energy", "emission", "solar",
    "wind", "hydrogen", "battery", "net zero", "net-zero", "decarboni", "sustainable", "COP",
    "Paris Agreement", "NDC", "CBAM", "energy transition", "EV", "electric vehicle",
]
AGGREGATOR_HOST = "news.google.com"

# --- fixed values: dimensions -----------------------------------------------
DIM_POLICY, DIM_INDUSTRY, DIM_MARKET, DIM_AI = "政策", "产业", "市场信号", "AI"
DIMENSIONS = [DIM_POLICY, DIM_INDUSTRY, DIM_MARKET, DIM_AI]
AI_WORDS = [
    "人工智能", "大模型", "机器学习", "智能电网", "数字孪生", "碳监测", "能碳", "智算", "算法",
    "机器人", "具身智能", "无人机", "卫星", "自动驾驶", "artificial intelligence",
    "machine learning", "smart grid", "robot", "humanoid", "autonomous", "drone", "satellite",
    "大语言模型", "多模态", "生成式", "深度学习", "神经网络", "transformer", "llm", "gpt",
    "claude", "gemini", "deepseek", "qwen", "llama", "agent", "智能体", "推理", "训练", "算力",
    "芯片", "gpu", "英伟达", "openai", "anthropic", "google deepmind", "meta ai",
    "hugging face", "ai芯片", "ai应用", "ai模型", "模型发布", "ai创业", "ai融资",
    "机器学习模型", "计算机视觉", "自然语言处理", "强化学习", "aigc", "大模型创业",
    "模型即服务", "ai agent", "mcp", "语义", "transformer架构", "data centre", "data center",
    "数据中心", "diffusion",
]
DUAL_CARBON_WORDS = [
    "碳中和", "碳达峰", "双碳", "碳排放", "碳减排", "净零", "降碳", "碳足迹", "碳普惠",
    "碳中和管理", "零碳", "气候中和", "net zero", "net-zero", "carbon neutral",
    "carbon neutrality", "decarboni", "emission reduction", "climate action",
    "climate policy", "energy transition", "netzero",
]
GOVERNMENT_WORDS = [
    "印发", "通知", "意见", "条例", "规划", "方案", "发布会", "答记者问", "解读", "一图读懂",
    "政策", "国务院", "十五五", "法规", "实施", "行动方案", "指导意见", "政策文件", "政策解读",
    "标准", "规范", "部委", "发改委", "发展改革委", "能源局", "生态环境部", "工信部", "生态环境",
    "住建部", "财政部", "商务部", "交通运输部", "水利部", "农业农村部", "人民银行", "央行",
    "国资委", "科技部", "policy", "policies", "regulation", "regulatory", "legislation",
    "reform", "roadmap", "framework", "agreement", "government", "minister", "parliament",
    "mandate", "consultation", "strategy", "commitment", "target", "goal", "official",
    "ministry", "department", "commission", "agency",
]
FINANCE_WORDS = [
    "碳市场", "碳交易", "碳价", "碳配额", "碳关税", "CBAM", "CCER", "ESG", "绿色金融", "碳金融",
    "债券", "融资", "投资", "基金", "期货", "收购", "并购", "IPO", "股价", "碳资产", "绿色债券",
    "成交", "carbon market", "carbon price", "carbon trading", "ETS", "green bond", "finance",
    "investment", "fund",
]
INDUSTRY_WORDS = [
    "储能", "氢能", "光伏", "风电", "电池", "CCUS", "碳捕集", "技术", "研发", "突破", "材料",
    "工艺", "装备", "光热", "绿氢", "甲醇", "甲烷", "负排放", "DAC", "BECCS", "生物炭", "核能",
    "生物质", "装机", "投产", "并网", "产能", "产量", "出口", "工厂", "公司", "集团", "项目",
    "电站", "电网", "充电桩", "电动车", "新能源汽车", "solar", "wind", "battery", "hydrogen",
    "storage", "technology", "carbon capture", "renewable", "nuclear", "factory", "plant",
    "gigafactory", "ev", "electric vehicle",
]
POLICY_WEAK_WORDS = [
    "目标", "承诺", "路线图", "白皮书", "纲要", "立法", "修正案",
    "target", "pledge", "white paper", "outline", "amendment",
]

# --- fixed values: content strength tiers per dimension ----------------------
STRENGTH_TIERS = {
    DIM_POLICY: [
        (30, ["印发", "通知", "意见", "条例", "办法", "规划", "方案", "公告", "答记者问",
              "政策文件", "发布", "国务院"]),
        (25, ["解读", "一图读懂", "新闻发布会", "吹风会"]),
        (20, ["报告", "数据", "统计", "年报", "季报"]),
    ],
    DIM_INDUSTRY: [
        (30, ["突破", "首次", "首发", "成功", "世界首个", "全球首个", "里程碑", "实现", "投产",
              "并网", "交付", "建成"]),
        (20, ["进展", "研发", "上线", "落地", "试点", "示范", "应用", "试验", "回收", "产量",
              "扩产", "测试", "验证", "升级", "改造", "效率", "报告", "发布", "数据", "recycle",
              "yield", "output", "test", "upgrade", "efficiency"]),
    ],
    DIM_MARKET: [
        (30, ["扩围", "大涨", "突破", "新高", "首次", "创纪录", "启动", "成交", "破", "亿元",
              "覆盖"]),
        (20, ["价格", "指数", "报告", "数据", "融资", "投资", "交易", "配额"]),
    ],
    DIM_AI: [
        (30, ["落地", "应用", "发布", "大模型", "智能体", "突破", "首发", "平台", "上线", "部署",
              "启用", "治理", "监管", "问责", "合规", "立法", "管控", "国家安全", "网络安全",
              "民主监督", "governance", "oversight", "regulation", "regulatory",
              "accountability", "national security", "cybersecurity", "democratic", "safety",
              "cyber"]),
        (20, ["研究", "方法", "评估", "预测", "优化", "监测", "算法", "模型", "adaptation",
              "response", "pathway", "framework", "system", "tool", "dataset", "workshop",
              "grant"]),
    ],
}
STRENGTH_DEFAULT = 8

# --- fixed values: topic relevance tiers --------------------------------------
TOPIC_TIERS = [
    (25, ["碳市场", "碳交易", "CCER", "CBAM", "碳关税", "碳价", "碳排放权", "双碳", "碳中和",
          "碳达峰", "碳足迹", "碳普惠", "碳配额", "carbon market", "carbon price",
          "carbon border", "emissions trading", "net zero", "net-zero", "ETS"]),
    (18, ["新能源", "储能", "氢能", "光伏", "风电", "新型电力系统", "电力市场", "绿电", "零碳",
          "CCUS", "碳捕集", "绿色金融", "ESG", "循环经济", "电动车", "电动汽车", "renewable",
          "solar", "wind", "hydrogen", "battery", "energy storage", "electric vehicle",
          "人工智能", "大模型", "智能电网", "数字孪生", "能碳", "AI", "碳监测",
          "artificial intelligence", "machine learning", "smart grid"]),
    (12, ["节能", "环保", "气候", "绿色", "低碳", "减排", "污染防治", "生态环境", "能源转型",
          "电力", "煤炭", "天然气", "成品油", "climate", "green", "emission", "decarbon",
          "sustainable", "environment", "energy transition", "coal"]),
]
TOPIC_DEFAULT = 6

# --- fixed values: freshness (upper bound in hours, points) and levels -----------
FRESHNESS_STEPS = [(24, 10), (48, 8), (72, 6), (96, 4)]
FRESHNESS_OLD, FRESHNESS_UNKNOWN = 2, 0
LEVELS = [(85, "S"), (70, "A"), (55, "B"), (40, "C")]
LEVEL_LOWEST = "D"
SCORE_MAXIMA = {"source": 25, "strength": 30, "topic": 25, "people": 10, "freshness": 10}

# --- fixed values: regions (order is priority; matched in the lower-cased title) --
REGIONS = [
    ("中国", ["中国", "我国", "国内", "国家发改委", "发展改革委", "工信部", "国务院", "生态环境部",
             "能源局", "人民银行", "央行", "全国碳市场", "国产", "china", "beijing", "shanghai",
             "shenzhen"]),
    ("欧盟", ["欧委会", "欧盟", "欧洲", "马耳他", "德国", "法国", "英国", "意大利", "西班牙", "荷兰",
             "比利时", "芬兰", "瑞典", "波兰", "葡萄牙", "爱尔兰", "丹麦", "奥地利", "希腊",
             "匈牙利", "捷克", "罗马尼亚", "保加利亚", "克罗地亚", "斯洛文尼亚", "斯洛伐克",
             "立陶宛", "拉脱维亚", "爱沙尼亚", "eu ", "european", "brussels", "germany",
             "france", "italy", "spain", "poland", "netherlands", "sweden", "portugal"]),
    ("美国", ["美国", "特朗普", "拜登", "加州", "us ", "u.s.", "america", "washington", "trump",
             "biden", "california"]),
    ("日本", ["日本", "东京", "japan", "tokyo"]),
    ("印度", ["印度", "india"]),
    ("国际", ["国际", "联合国", "全球", "伊朗", "中东", "沙特", "澳大利亚", "巴西", "加拿大",
             "俄罗斯", "韩国", "乌克兰", "印尼", "越南", "非洲", "挪威", "瑞士", "新加坡",
             "以色列", "土耳其", "墨西哥", "智利", "阿根廷", "哥斯达黎加", "新西兰",
             "international", "united nations", "global", "iran", "brazil", "canada",
             "russia", "korea", "ukraine", "australia", "saudi", "singapore", "turkey",
             "mexico", "chile"]),
]
HOME_REGION = "中国"

# --- fixed values: topic tags (order is output order) ------------------------------
TOPIC_TAGS = [
    ("碳市场", ["碳交易", "碳市场", "碳价", "碳配额", "碳关税", "CBAM", "CCER", "碳排放权", "碳排",
              "carbon market", "carbon price", "carbon trading", "emissions trading", "ETS",
              "carbon border", "carbon", "emission", "emissions"]),
    ("新能源", ["新能源", "光伏", "风电", "光热", "氢能", "核能", "生物质", "水电", "solar",
              "wind power", "wind", "hydrogen", "nuclear", "renewable energy", "renewables"]),
    ("储能", ["储能", "电池", "抽水蓄能", "battery", "energy storage"]),
    ("电力", ["电力", "电网", "电价", "电力市场", "新型电力系统", "消纳", "用电", "发电",
             "electricity", "power grid", "power market"]),
    ("化石能源", ["煤炭", "石油", "天然气", "成品油", "LNG", "coal", "oil", "natural gas",
               "fossil fuel"]),
    ("节能降碳", ["节能", "能效", "绿色制造", "绿色低碳", "零碳工厂", "减排", "降碳",
               "energy efficiency", "decarboni", "net zero", "net-zero", "zero carbon"]),
    ("气候变化", ["气候", "COP", "NDC", "巴黎协定", "碳中和", "碳达峰", "双碳", "温室气体",
               "climate change", "climate policy", "climate", "paris agreement",
               "greenhouse"]),
    ("绿色金融", ["ESG", "绿色金融", "碳金融", "碳资产", "green finance", "green bond"]),
    ("环境保护", ["生态环境", "环境保护", "污染防治", "空气质量", "蓝天保卫战", "environment",
               "pollution", "air quality", "conservation", "wildlife"]),
    ("循环经济", ["循环经济", "资源循环", "废弃物", "circular economy"]),
    ("电动车", ["电动车", "电动汽车", "EV", "充电桩", "electric vehicle"]),
    ("政策法规", ["条例", "办法", "规定", "标准", "规范", "法律法规", "司法解释", "regulation",
               "legislation"]),
    ("AI科技", ["人工智能", "AI", "大模型", "机器学习", "智能电网", "数字孪生", "碳监测", "能碳",
              "智算", "算法", "数字化", "数智化", "artificial intelligence",
              "machine learning", "smart grid"]),
]

# --- fixed values: document types ------------------------------------------------
DOCUMENT_TYPES = [
    ("政策解读", ["解读", "专家", "一图读懂", "答记者问"]),
    ("政策文件", ["通知", "意见", "办法", "条例", "规划", "方案", "公告", "印发", "关于印发"]),
    ("新闻发布会", ["新闻发布会", "答问", "通报", "发布", "发布会"]),
    ("数据报告", ["报告", "数据", "统计", "年报", "季报"]),
]
DOCUMENT_TYPE_DEFAULT = "行业动态"

# --- fixed values: people and role tiers -------------------------------------------
PEOPLE = [
    ("郑栅洁", "国家发改委主任"),
    ("周海兵", "国家发改委副主任"),
    ("沈竹林", "国家发改委副主任"),
    ("李春临", "国家发改委副主任"),
    ("黄润秋", "生态环境部部长"),
    ("孙金龙", "生态环境部党组书记"),
    ("赵英民", "生态环境部副部长"),
    ("万劲松", "国家能源局副局长"),
    ("李乐成", "工信部部长"),
    ("林伯强", "厦门大学中国能源政策研究院院长"),
    ("魏一鸣", "北京理工大学能源与环境政策研究中心教授"),
    ("杨昆", "中电联党委书记、常务副理事长"),
    ("卢书剑", "西南证券电新行业联席首席分析师"),
    ("张维鑫", "中信建投期货分析师"),
    ("郑小霞", "华安证券研究所联席所长、首席经济学家"),
    ("傅强", "罗兰贝格副合伙人、能源行业首席专家"),
    ("张玉昕", "弘则研究分析师"),
]
ROLE_TIERS = [
    (10, ["部长", "主任", "党组书记", "局长"]),
    (7, ["副主任", "副部长", "副局长"]),
    (5, ["院长", "教授", "理事长", "所长"]),
    (3, ["分析师", "首席"]),
]
PAGE_TITLE_CHARS = 120

# --- fixed values: digest -------------------------------------------------------------
DIMENSION_ICONS = {DIM_POLICY: "🏛️", DIM_INDUSTRY: "🔋", DIM_MARKET: "💰", DIM_AI: "🤖"}
DIGEST_SITES = 47
# a title repeated at the head of a summary: times, characters allowed before it, characters that must be equal, edges cut off
REPEATED_TITLE = (3, 2, 12)
REPEATED_TITLE_EDGES = r"^[ ，。、：:；;,.·\-—]+|[ ，。、：:；;,.·\-—]+$"

# --- fixed values: title and link junk -----------------------------------------------
TITLE_SEPARATORS = [" - ", " — ", " – ", " | ", " ｜ ", " _ "]
PAGE_TITLE_SEPARATORS = ["_", "｜", "|", "——", "-", "–", "—"]
TAIL_WORDS = ["news", "press", "releases", "updates", "media", "staff", "report", "blog",
              "daily", "weekly", "monthly"]
CJK_SITE_TAIL = ("(网|官网|委员会|政府|部$|中心|门户|交易所|资讯|信息网|服务网|新闻中心"
                 "|生态环境部|发展和改革委员会|环境省|经产省|環境局|環境省|経産省|資源エネルギー庁)")
FEED_SOURCE_TAIL = (r"(\.gov|\.com|\.in|\.org|\.go\.jp|网|官网|委员会|政府|中心|门户|部$|"
                    r"PIB|EPA|DOE|NOAA|EIA|FERC|Euractiv|IEA|IRENA|NHC|CPC|"
                    r"Administration|Commission|Agency|Department|Bureau|Institute)")
PUBLISHER_NAMES = (r"(cleantechnica|reuters|carbon brief|asian business review|euractiv|"
                   r"world bank|department of energy|environmental protection|us epa|u\.s\. epa|"
                   r"european commission|climate change ai|venturebeat|bloomberg|guardian|"
                   r"financial times|scientific american|the economist|agora|e3g|mongabay)")
PAGE_PUBLISHER_NAMES = PUBLISHER_NAMES.replace("|mongabay", "")
LINK_JUNK_TEXT = ["注册", "登录", "协议", "条款", "关于", "联系我们", "备案", "版权", "下载", "APP",
                  "VIP", "会员", "沪ICP", "隐私", "帮助", "常见问题", "手机版", "客户端", "订阅",
                  "投稿", "广告", "合作", "招聘", "收藏本站", "设为首页", "返回顶部", "邮箱快捷",
                  "短信快捷", "使用协议", "用户协议", "English", "简体", "繁體", "微博", "微信",
                  "QQ群"]
LINK_JUNK_URL = ["/user/", "/login", "/register", "/about", "/aboutus", "/terms", "/privacy",
                 "/protocol", "/copyright", "/disclaimer", "/faq", "/help", "/jobs", "/advert",
                 "/contact", "/member", "/vip", "/profile", "/abouts", "/header_tab",
                 "javascript:", "mailto:", "tel:", "#", "/xiey", "/hezuo", "/guanggao"]
NAV_TITLES = [
    "english releases", "photo album", "blogdescription", "pib backgrounder",
    "reports archives", ".* archives", "archives", "glossary", "education",
    "data in the classroom", "station home page", "tide predictions", "daily weather map",
    "pib", "eia webinars", "short-term energy outlook", "contact us", "about us", "opendata",
    "databases", "dashboard", "webinars", "maps and data", "energy explained", "faqs",
    "hourly electric grid monitor", "real-time operating grid", "new england dashboard",
    "weekly petroleum status report", "gasoline and diesel fuel update", "steo data browser",
    "learn more about", "map a career", "renewable energy maps", "data access viewer",
    "sea level analysis tool", "archived directives", "women in energy", "from our blogs",
    "grid talk", "innovation", "energy workforce", "find careers", "find financing",
    "credit subsidy", "technical project officer", "collegiate wind competition",
    "state energy advisory board", "shara mohtadi", "veronica jackson", "deploy 2024",
    "energy improvements in rural", "getting to know lpo", "loan program office",
    "aes marahu", r"u\.s\. energy & employment report", "marine energy basics",
    "regional clean hydrogen hubs", "quarterly solar industry update",
    "critical minerals and materials", "solar workforce", "solar photovoltaic",
    "types of hydropower", "how distributed wind", "hydrogen production",
    "solar cybersecurity", "end-of-life management for solar", "3 reasons why nuclear",
    "5 fast facts about nuclear", "does eia project", "what can i expect to pay for heating",
    r"national weather service marine forecast\b.*",
    r"tropical storm \w+ forecast discussion\b.*", r"station \d+\b.*",
    r"station [a-z0-9]{3,6} \b.*", r"snow station information\b.*", "multi-state regions",
    "electric matters", "statements and speeches", "data tool", "air quality system",
    "public water system service areas", "clean school bus program",
    "transmission facility financing", "what types of cmei funding exist",
    "30d new clean vehicle credit", r"u\.s\. energy information administration\b.*",
    r"southwestern power administration\b.*", r"california air resources board\b.*",
    r"federal energy regulatory commission\b.*", r"national hurricane center\b.*",
    r"climate prediction center\b.*",
]
GENERIC_TITLES = (
    r"(press release page|press information bureau|home\s*[|—–-]?|news\s*[|—–-]?|"
    r"english releases|photo album|blogdescription|pib backgrounder|"
    r"independent statistics and analysis|california air resources board|"
    r"snow station information|national hurricane center|main navigation|navigation menu|"
    r"today in energy|page not found|\b404\b|contact us|"
    r"computer science\s*>|github\s*-\s*[\w.-]+/[\w.-]+|"
    r"即将离开|是否继续|正在跳转|"
    r"相关阅读推荐|您可能对以下文章感兴趣|相关推荐|热门推荐|热点新闻|"
    r"^[\x{4e00}-\x{9fff}]{2,24}(网|中心|部|局|署|厅|院|站|官网|门户|平台)[\s\x{3000}]*[-—–|｜_][\s\x{3000}]*"
    r"[\x{4e00}-\x{9fff}]{0,8}?"
    r"(研究|动态|要闻|新闻|资讯|公告|通知|政策|法规|标准|专题|党建|简介|概况|机构|"
    r"服务|指南|文献|期刊|学报|目录|下载|数据|资源|招聘|版权|联系我们|首页|信息公开|"
    r"政务公开|互动交流|办事服务|政策法规|专题报道|工作动态|行业动态)\s*$)")
ERROR_MARKERS = ["抱歉，您访问的地址有错", "页面不存在", "您访问的页面不存在", "您访问的页面已经删除",
                 "访问出错了", "页面无法访问", "404 not found", "page not found", "error 404"]
FIXED_SUFFIXES = ["-国家发展和改革委员会", "-国家发展和改革委", "-国家发改委", "-碳排放交易网",
                  "-生态环境部", "-国家能源局", "_碳排放交易网"]
AGENCY_TAILS = [
    r"[-—–|｜_]\s*U\.S\. Energy Information Administration(?: \(EIA\))?(?: \(\.gov\))?",
    r"[-—–|｜_]\s*U\.S\. Environmental Protection Agency(?: \(\.gov\))?",
    r"[-—–|｜_]\s*Environmental Protection Agency(?: \(\.gov\))?",
    r"[-—–|｜_]\s*Federal Energy Regulatory Commission(?: \(\.gov\))?",
    r"[-—–|｜_]\s*Department of Energy(?: \(\.gov\))?",
    r"[-—–|｜_]\s*California Air Resources Board(?: \(\.gov\))?",
    r"[-—–|｜_]\s*NOAA Office for Coastal Management(?: \(\.gov\))?",
    r"[-—–|｜_]\s*NOAA Tides and Currents(?: \(\.gov\))?",
    r"[-—–|｜_]\s*NOAA(?: \(\.gov\))?",
    r"[-—–|｜_]\s*NOAA\s+(?:National\w*|Office\w*|Tides\w*)[\w\s']*?(?:\([A-Z]+\))?\s*(?:\(\.gov\))?\s*\.{0,3}",
    r"[-—–|｜_]\s*National Hurricane Center",
    r"[-—–|｜_]\s*NHC(?: \(\.gov\))?",
    r"[-—–|｜_]\s*Climate Prediction Center",
    r"[-—–|｜_]\s*EPA",
    r"[-—–|｜_]\s*Southwestern Power Administration",
    r"[-—–|｜_]\s*taiyangnews\.info",
    r"-\s*上海环境能源交易所",
    r"[-—–|｜_]\s*(?:News|Press|Releases?|Updates?|Staff|Report|Blog|Daily|Weekly|Monthly|Media)",
]
CORPUS_NAV_EXACT = [
    "contact us", "about", "about us", "glossary", "opendata", "databases", "dashboard",
    "webinars", "tide predictions", "daily weather map", "data in the classroom", "education",
    "maps and data", "energy explained", "faqs", "learn more about energy sources",
    "map a career in energy", "renewable energy maps and tools", "data access viewer",
    "sea level analysis tool", "archived directives library", "women in energy",
    "from our blogs", "grid talk", "innovation", "energy workforce", "find careers in cmei",
    "find financing for energy-efficiency upgrades", "credit subsidy",
    "technical project officer", "collegiate wind competition 2023 judges",
    "international science & technology collaboration", "state energy advisory board",
    "shara mohtadi", "veronica jackson", "deploy 2024",
    "energy improvements in rural or remote areas", "getting to know lpo",
    "loan program office", "aes marahu", "critical minerals and materials",
    "short-term energy outlook", "weekly petroleum status report",
    "gasoline and diesel fuel update", "steo data browser", "hourly electric grid monitor",
    "real-time operating grid", "new england dashboard", "united states",
    "southwestern power administration", "national weather service marine forecast",
    "electric matters", "electric matters - m", "statements and speeches",
    "multi-state regions", "air quality system (aqs)", "public water system service areas",
    "clean school bus program",
    "does eia project energy production, consumption, or prices for individual states",
    "what can i expect to pay for heating this winter",
    "u.s. energy information administration", "california air resources board",
    "federal energy regulatory commission", "national hurricane center",
    "national hurricane center and central pacific hurricane center",
    "snow station information", "climate prediction center", "documentation",
    "what types of cmei funding exist", "transmission facility financing",
    "regional clean hydrogen hubs", "quarterly solar industry update",
    "u.s. energy & employment report", "marine energy basics", "cybersecurity",
    "solar workforce development",
    "u.s.", "eia", "noaa", "epa", "doe", "ferc", "nhc", "mee", "pib",
]
CORPUS_NAV_PATTERNS = [
    r"^station\s+[\w\s\-,#'()]+$", r"^national weather service marine forecast",
    r"^tropical storm \w+ forecast discussion", r"^(climate prediction center|enso).*",
    r"^latest commit", r"^snow station information",
    r"^u\.s\. energy information administration", r"^southwestern power administration",
    r"^(does eia project|what can i expect|what is general conformity)",
]
STATIC_PAGES = [
    "3 reasons why nuclear is clean and sustainable", "5 fast facts about nuclear energy",
    "solar photovoltaic technology basics", "types of hydropower plants",
    "how distributed wind works", "hydrogen production_ electrolysis",
    "solar cybersecurity", "end-of-life management for solar photovoltaics",
    "solar rooftop potential", "solar workforce development",
    "updates to the section 1703 loan guarantee program", "30d new clean vehicle credit",
    "nepa schedule for pending infrastructure projects",
    "notice regarding dispute resolution procedures",
    "ferc issues notice for dispute resolution services proceedings for pjm governance",
    "july_august 2026 highlights",
    "public notice: final permit decision to issue a permit under the clean air act",
    "epa - office of agriculture and rural affairs", "weather and climate indicators",
    "clean trucks plan", "ethylene oxide", "u.s. energy & employment report",
    "climate prediction center: enso diagnostic discussion", "data in the classroom",
    "sea level analysis tool",
]
INDEX_BAD_TITLES = (
    r"公共服务网|即将离开|\.gov\)|\(EIA\)|\(NOAA\)|\(EPA\)|\(DOE\)|"
    r"U\.S\. Energy Information Administration|California Air Resources Board|"
    r"Federal Energy Regulatory Commission|National Hurricane Center|"
    r"Southwestern Power Administration|Snow Station Information|"
    r"^Computer Science\s*>|^GitHub - |^#?\s*国家节能中心公共服务网")
AUDIT_BAD_TITLES = (
    r"公共服务网|门户网站|欢迎访问|欢迎来到|^首页|"
    r"^#?\s*[^-—–|｜_]{2,25}[网中心部局署厅院站][^-—–|｜_]{0,8}[-—–|｜_]\s*"
    r"(首页|官网|门户|简介|关于我们|新闻|资讯|动态|要闻|工作动态|最新公告|通知公告|政务公开|"
    r"政策文件|信息公开|行业动态|节能研究)\s*$")
SUSPICIOUS_TITLES = "公共服务网|门户网站|欢迎访问|欢迎来到"
SCOPE_JUNK_TITLES = r"\.gov\)|\(EIA\)|\(NOAA\)|\(EPA\)|\(DOE\)|Administration|公共服务网|即将离开"
POLLUTED_SUMMARY = r"小编\s*[·.]\s*\d{4}-\d{2}-\d{2}.*?阅读量|^摘要[:：]|文章来源|我的位置"
DOMAIN_COM = r"(?:c[\s\.]*o[\s\.]*m|ｃ[\s\.]*ｏ[\s\.]*ｍ|ｃ[\s\.]*ō[\s\.]*ｍ)"
WATERMARKS = [
    r"(?:本[`+%@$#/*]*文|本文|夲呅|禸嫆|内|內|容)[^\n]{0,150}?碳[^\n]{0,150}?(?:网|網)[^\n]{0,150}?" + DOMAIN_COM,
    r"禸\*?嫆[^\n]{0,120}?(?:ｃ[\s\.]*ｏ[\s\.]*ｍ|ｃ[\s\.]*ō[\s\.]*ｍ)",
    r"(?:本[`+%@$#/*]*文|本文|夲呅|禸\*?嫆)[^\n]{0,150}?(?:来|來|唻)[^\n]{0,100}?(?:自|洎|亍)?"
    r"[^\n]{0,150}?(?:碳)?[^\n]{0,100}?(?:网|網)?[^\n]{0,100}?(?=$|['\"])",
]
SOURCE_ORG = r"来源[:：]\s*([^\s][^，。；;]{1,29})"
STOP_WORDS = (
    "的 了 是 在 和 与 及 等 中 为 将 对 并 由 通过 表示 称 指出 记者 报道 相关 进行 以及 我们 他们 其 该 "
    "这 那 有 也 就 都 而 但 或 一个 没有 不是 被 把 从 向 到 于 年 月 日 个 上 下 后 前 内 外 说 "
    "显示 据 据悉 目前 近日 今天 昨日 新 大 小 更 最 已 能 会 要 可 以 各 每 多 少 万 亿 元 人 公司 "
    "中国 美国 欧洲 日本 印度 政府 国际 全球 the a an and of to in for on with is are was were be by "
    "as at or from this that it its not have has had").split()
NOTE_INDEX_FILES = ["政策库.md", "媒体库.md", "ai-index.md"]
NOTE_LIBRARY_DIR = {"policy": "政策库", "media": "媒体库"}
LINK_PREFIX_FIX = ("../../policy/../../政策库/", "../../政策库/")
NOTE_ALLOWED_KEYS = ["source", "url", "date", "published", "tags", "keywords", "summary"]
CATALOGUE_SUMMARY_CHARS = 150
CATALOG_SKIPPED_TAGS = ["MOC", "政策库", "媒体库", "wiki"]
SECTION_PRIORITY = [("/jns/gzdt/", 0), ("/jns/wjfb/", 1)]
SECTION_DEFAULT = 2
LIBRARY_MOVES = [
    ("国家发改委", "政策库/中国"), ("国家能源局", "政策库/中国"), ("生态环境部", "政策库/中国"),
    ("工信部", "政策库/中国"), ("IEA", "政策库/国际组织"), ("IRENA", "政策库/国际组织"),
    ("UNFCCC", "政策库/国际组织"), ("World Bank Climate", "政策库/国际组织"),
    ("中国碳交易网", "媒体库"), ("中国能源报", "媒体库"), ("北极星电力网", "媒体库"),
    ("碳道", "媒体库"), ("Carbon Brief", "媒体库"), ("Reuters", "媒体库"),
]
