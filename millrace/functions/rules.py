"""Keyword rules, categories and serving rules: fixed values, and the Columns that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, keyword_category

# The main category of each cross type.
CROSS_CATEGORY = {
    "timer_game": "timer",
    "calculator_game": "calculator",
    "timer_tracker": "timer",
    "converter_lifestyle": "converter",
    "tracker_health": "tracker",
    "game_social": "game",
    "education_game": "education",
    "health_timer": "health",
    "lifestyle_calculator": "lifestyle",
    "entertainment_tracker": "entertainment",
    "finance_lifestyle": "finance",
    "parenting_game": "parenting",
}
# Categories that say nothing of the item.
NO_CATEGORY = ["cross_category", "seed_multi_impl", ""]
# The words of each category of an instruction, the first match counts.
INSTRUCTION_CATEGORIES = [
    ("timer", ["计时", "秒表", "倒计时", "番茄", "计数器"]),
    ("calculator", ["计算器", "bmi", "小费", "折扣", "分摊", "面积"]),
    ("converter", ["换算", "转换", "互转", "进制"]),
    ("game", ["游戏", "猜", "石头", "剪刀", "打地鼠", "棋"]),
    ("tracker", ["记录", "待办", "打卡", "清单", "日历"]),
    ("health", ["健康", "卡路里", "体脂", "血压", "睡眠", "呼吸"]),
    ("lifestyle", ["生活", "吃什么", "倒数日", "备忘", "天气"]),
    ("education", ["学习", "单词", "成绩", "gpa", "口算", "古诗", "乘法"]),
    ("entertainment", ["随机", "密码", "颜色", "抛硬币", "星座", "塔罗"]),
    ("creative", ["画板", "日记", "节拍", "评分"]),
    ("social", ["投票", "记分板", "分组", "抽奖", "红包"]),
    ("finance", ["房贷", "复利", "存钱", "理财", "税"]),
    ("parenting", ["宝宝", "儿童", "孩子", "月龄", "育儿"]),
    ("planner", ["日程", "课程表", "规划", "周计划"]),
    ("utility", ["文本", "markdown", "编码", "正则"]),
]
# The words of each category of the split, the first match counts.
SPLIT_CATEGORIES = [
    ("计时器/秒表", ["倒计时", "秒表", "计时", "timer"]),
    ("随机/骰子", ["骰子", "硬币", "随机", "抽签", "抽奖", "转盘"]),
    ("计算器", ["计算器", "计算", "进制", "百分比"]),
    ("换算工具", ["换算", "互转", "单位", "温度", "长度", "重量", "汇率"]),
    ("记分/投票", ["记分", "投票", "评分"]),
    ("猜数/游戏", ["猜数", "剪刀布", "游戏", "翻牌", "井字棋", "扫雷", "打地鼠", "贪吃蛇", "弹球", "华容道"]),
    ("番茄钟", ["番茄", "专注"]),
    ("待办/清单", ["待办", "清单", "打卡", "习惯", "打包"]),
    ("记账/理财", ["记账", "账", "存钱", "预算", "收入", "支出", "房贷", "利息", "股票", "工资"]),
    ("日历/日期", ["日历", "纪念日", "倒数日", "日期", "考试倒计时", "月龄", "孕周"]),
    ("画板/创意", ["画板", "涂色", "颜色", "画画", "Markdown"]),
    ("记录/日记", ["备忘", "日记", "记录", "心情", "喝水", "喂奶", "血压", "体重"]),
    ("音频/节拍", ["节拍", "白噪音", "音乐", "声音"]),
    ("打字/测试", ["打字", "反应", "视力", "速度测试", "专注力"]),
    ("教育/学习", ["乘法", "单词", "GPA", "课程表", "古诗", "口算", "元素周期表"]),
    ("生活工具", ["密码", "字数", "年龄", "小费", "AA", "面积", "时间间隔", "电费", "快递", "垃圾分类", "穿衣", "食谱"]),
    ("社交/娱乐", ["真心话", "卧底", "表白", "星座", "生肖", "塔罗", "情话"]),
    ("育儿", ["宝宝", "儿童", "小朋友", "故事计时"]),
    ("团建/分组", ["分组", "座位", "红包分配", "团建"]),
]
# The categories that are held out for validation, and those that only train.
HELD_OUT_CATEGORIES = ["creative", "social", "finance", "parenting", "planner", "utility", "other", "cross_category"]
TRAIN_ONLY_CATEGORIES = ["timer", "calculator", "converter", "game", "tracker", "health", "lifestyle", "education", "entertainment"]
# The levels; a category in neither list is of the middle one, no category is simple.
SIMPLE, MIDDLE, HARD = "L1_简单", "L2_中等", "L3_挑战"
SIMPLE_CATEGORIES = ["计时器/秒表", "随机/骰子", "计算器", "换算工具", "记分/投票"]
HARD_CATEGORIES = ["猜数/游戏", "音频/节拍", "打字/测试"]
NO_SPLIT_CATEGORY = "其他"


def item_category(category, cross_type, instruction) -> Column:
    """An item's own category; else that of its cross type; else by its instruction's words."""
    own = F.coalesce(col(category), F.lit(""))
    cross = F.coalesce(col(cross_type), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in CROSS_CATEGORY.items() for x in pair))
    return (
        F.when(~own.isin(NO_CATEGORY), own)
        .when(cross != "", F.coalesce(F.element_at(known, cross), F.lit("cross_category")))
        .otherwise(keyword_category(F.coalesce(col(instruction), F.lit("")), INSTRUCTION_CATEGORIES, "other"))
    )


def split_category(instruction) -> Column:
    return keyword_category(instruction, SPLIT_CATEGORIES, NO_SPLIT_CATEGORY)


def category_level(category) -> Column:
    """The level of a split category."""
    c = col(category)
    return F.when(c.isin([*SIMPLE_CATEGORIES, NO_SPLIT_CATEGORY]), SIMPLE).when(c.isin(HARD_CATEGORIES), HARD).otherwise(MIDDLE)
