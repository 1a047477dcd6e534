"""Serving rules: fixed values."""

# The word that an instruction holds, and the seed instruction whose page serves it; the first counts.
TEMPLATE_WORDS = [
    ("番茄钟", "做一个番茄钟，25分钟工作5分钟休息，自动轮次切换"),
    ("画板", "做一个简易画板可以画画"),
    ("记账", "做一个简易记账本，可以记收入和支出"),
    ("喝水", "做个喝水提醒工具，记录每天喝了几杯水，目标8杯"),
    ("密码生成", "做一个随机密码生成器"),
    ("打字速度", "做一个打字速度测试工具"),
    ("待办事项", "做一个待办事项列表，可以添加勾选和删除"),
    ("节拍器", "做一个节拍器，可以调节BPM"),
    ("倒计时", "做一个倒计时器，可以设定分钟数，有开始暂停和重置按钮"),
    ("秒表", "帮我做个秒表，有开始停止和清零功能"),
    ("骰子", "做一个掷骰子工具，点击按钮随机出1到6的点数"),
    ("硬币", "弄个抛硬币的小工具"),
    ("吃什么", "做一个随机选择器，帮我决定今天吃什么"),
    ("BMI", "帮我做一个BMI计算器，输入身高体重就能算"),
    ("温度换算", "做一个摄氏和华氏温度的换算器"),
    ("记分板", "做一个两队记分板，可以加分减分"),
    ("猜数字", "做个猜数字游戏，1到100之间猜"),
    ("计算器", "做个简单的计算器，加减乘除"),
    ("年龄计算", "做个年龄计算器，输入生日算出年龄"),
    ("百分比", "帮我做个百分比计算器"),
    ("倒数日", "做一个倒数日工具，输入日期显示还有几天"),
    ("随机颜色", "做个随机颜色生成器"),
    ("石头剪刀布", "做一个石头剪刀布游戏"),
    ("计数器", "做一个简单计数器，可以加一减一"),
    ("字数统计", "做一个字数统计工具"),
    ("随机数", "做一个随机数生成器，可以设定范围"),
    ("进制转换", "帮我做一个进制转换器"),
    ("小费", "做一个小费计算器"),
    ("AA", "做一个AA制算账工具，输入总金额和人数"),
    ("面积", "做一个面积计算器，支持正方形长方形和圆形"),
    ("反应速度", "做个反应速度测试"),
    ("投票", "弄个简单投票工具，可以添加选项让大家投票"),
    ("折扣", "做一个折扣计算器"),
    ("汇率", "做个汇率换算器，人民币和美元互转"),
    ("打卡日历", "做一个打卡日历，点击日期标记已完成"),
    ("习惯打卡", "做一个习惯打卡工具，可以添加多个习惯每天打卡"),
    ("闪卡", "帮我做一个闪卡记忆工具，可以翻转查看答案"),
    ("购物清单", "做一个购物清单，可以添加物品和标记已购买"),
    ("心情", "做一个心情记录器，每天选一个心情保存"),
    ("备忘录", "做个简单的备忘录工具"),
    ("日程", "帮我做一个日程表，可以给每个小时添加事项"),
    ("评分", "做一个评分卡，可以给1到5星评分"),
    ("日记", "做一个简易日记本"),
    ("呼吸", "做一个呼吸练习引导工具"),
    ("颜色记忆", "做一个颜色记忆游戏"),
    ("白噪音", "做一个白噪音播放器，有几种不同的环境音效果"),
]

# The pattern of a short instruction, and what is added to it; the first that adds something new counts.
SUFFIX_RULES = [
    (r"番茄[钟锺]", "，25分钟工作5分钟休息，有开始暂停和重置按钮，显示当前倒计时和轮次切换"),
    (r"倒计时", "，可以设定分钟数，有开始暂停和重置按钮"),
    (r"计算器", "，支持加减乘除，有清除和退格按钮"),
    (r"记分板", "，可以加分减分和重置"),
    (r"待办|todo", "，可以添加勾选和删除任务"),
    (r"秒表", "，有开始停止和清零功能"),
    (r"骰子", "，点击按钮随机出1到6的点数"),
    (r"硬币", "，点击抛出显示正面或反面"),
    (r"密码生成", "，可以调节长度，包含大小写字母数字和特殊字符"),
    (r"BMI", "，输入身高体重就能算，显示BMI值和健康状态"),
    (r"猜数字", "，1到100之间猜，提示大了还是小了"),
    (r"石头剪刀布", "，和电脑对战，显示胜负统计"),
    (r"记账|账本", "，可以记收入和支出，显示余额"),
    (r"打卡|习惯", "，可以添加习惯每天打卡，显示连续天数"),
    (r"温度换算", "，摄氏和华氏互转"),
    (r"字数统计", "，输入文字显示字符数词数和不含空格数"),
    (r"喝水", "，记录每天喝了几杯水，目标8杯，显示进度"),
    (r"画板", "，可以选颜色调粗细，有橡皮擦和清除功能"),
    (r"日记", "，可以写日记保存到本地，显示历史记录"),
    (r"备忘录", "，输入文字保存到本地，下次打开还在"),
    (r"日程", "，可以给每个小时添加事项"),
    (r"评分", "，可以给1到5星评分，显示评分结果"),
    (r"闪卡", "，显示问题点击翻转查看答案，可以切换上下张"),
    (r"购物清单", "，可以添加物品和标记已购买"),
    (r"心情", "，选择表情记录心情，显示历史"),
    (r"节拍器", "，可以调节BPM，有声音和视觉反馈"),
    (r"呼吸练习", "，吸气屏住呼气的引导动画"),
    (r"打字[速度测试]", "，显示文字让用户打字，计算WPM"),
    (r"颜色记忆", "，记住颜色顺序然后按顺序点击"),
    (r"白噪音", "，有雨声海浪风声等不同环境音"),
    (r"食谱|冰箱|菜", "，可以添加食材，有肉类蔬菜类主食类分类，显示各分类数量"),
    (r"卡路里|热量", "，选择食物和份量算出热量"),
    (r"血压", "，输入收缩压舒张压和心率，显示记录"),
    (r"体重", "，记录每天体重显示变化趋势"),
    (r"睡眠", "，输入入睡和起床时间算出睡眠时长"),
    (r"房贷", "，支持等额本息和等额本金两种方式"),
    (r"复利", "，输入本金利率和年数算出最终金额"),
    (r"GPA|绩点", "，输入各科成绩和学分算出绩点"),
    (r"乘法口诀|口算", "，随机出题计时作答"),
    (r"课程表", "，可以填写每天每节课的内容"),
    (r"纪念日", "，输入日期显示天数和各种纪念日"),
    (r"人生进度", "，显示今年已过去百分之多少"),
    (r"真心话大冒险", "，随机出题目"),
    (r"抽签", "，输入名字列表随机抽取"),
    (r"抽奖", "，输入参与者名单随机抽出中奖者"),
    (r"分组", "，输入人名和组数自动分组"),
    (r"井字棋", "，可以两个人轮流下"),
    (r"演讲计时", "，分段提醒绿黄红灯"),
    (r"密码强度", "，输入密码实时显示强度"),
]
# Fixed value: what is added to a very short instruction that no rule takes.
GENERIC_SUFFIX = "，界面美观，功能完整，有清晰的操作按钮"
